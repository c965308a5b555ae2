"""Explicit schemas of the record files; nothing is inferred, and model names stay map keys."""

from __future__ import annotations

SCORES = "struct<accuracy:double,completeness:double,topic_coherence:double,citation_quality:double,reasoning:string>"
#: A regulatory question with its reference answer, after renaming.
QUESTION = "question_id string, regulator string, id string, status string, legal_act string, topic string, subject_matter string, question string, answer string"
#: Answers and judge scores by model; reasoning is read as JSON text because it may be an object or a message.
JUDGE_RECORD = (
    "question_id string, regulator string, question string, ground_truth string, "
    f"answers map<string,struct<text:string,judge_scores:map<string,{SCORES}>>>, "
    "meta struct<answerer_models:array<string>,judge_models:array<string>,status:string,legal_act:string,topic:string,subject_matter:string,url:string>"
)
OLD_JUDGE_RECORD = "id string, question string, ground_truth string, candidate_answer string, scores struct<accuracy:double,completeness:double,clarity:double,overall:double,reasoning:string>, meta struct<answerer_model:string,judge_model:string,status:string,legal_act:string,topic:string,url:string>"
PREFERENCE_PAIR = (
    "question_id string, regulator string, question string, ground_truth string, chosen struct<model:string,text:string>, "
    "rejected struct<model:string,text:string,original_text:string,corruption_variant:string,corruptions_applied:array<string>>, "
    "majority_count bigint, unanimous boolean, max_abs_diff double"
)
EVAL_SCORES = f"question_id string, regulator string, scores map<string,map<string,{SCORES}>>"
EVAL_ANSWER = "question_id string, regulator string, question string, ground_truth string, baseline struct<model:string,text:string>, dpo struct<model:string,text:string>"
ARTICLES = "regulation string, total_articles_found bigint, articles array<struct<regulation:string,article_number:string,title:string,text:string,chapter:string,overlap_zones:array<string>,char_count:bigint>>"
