"""Record files: what is written is read back, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import files
from ..sources.folders import work_folder
from ..sources.views import JUDGMENTS_SQL, judgments, table

CONVERSATION = "conv_id long, turn long, role string, text string"


@query("select * from customer")
def csv_roundtrip(spark, sf_dir):
    """CSV sink and scan with a header and a schema."""
    path, rows = work_folder(spark, "csv"), table(spark, sf_dir, "customer")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("select * from conversations")
def jsonl_roundtrip(spark, sf_dir):
    """JSON lines sink and scan; letters of any script are written as they are."""
    path = work_folder(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return files.read_jsonl(spark, path, CONVERSATION)


@query("select * from conversations")
def json_array_rewrite(spark, sf_dir):
    """JSON lines rewritten as one JSON array, and read as such."""
    lines, array = work_folder(spark, "lines"), work_folder(spark, "array")
    files.write_jsonl(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), lines)
    files.rewrite_as_array_parts(spark, lines, array, CONVERSATION)
    return files.read_array_parts(spark, array, CONVERSATION)


@query("select n_nationkey as id, n_name as name from nation union all select r_regionkey, r_name from region")
def sniffed_scan(spark, sf_dir):
    """An array file and a lines file, told apart by their first character."""
    a, b = work_folder(spark, "array"), work_folder(spark, "lines")
    files.write_json_array(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), a)
    files.write_jsonl(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), b)
    return files.read_json(spark, a, "id int, name string").unionByName(files.read_json(spark, b, "id int, name string"))


@query(f"with {JUDGMENTS_SQL} select question_id, arg_max(accuracy, judge || answerer) as accuracy, max(judge) as judge from judgments group by question_id")
def keyed_jsonl(spark, sf_dir):
    """The last row of each question in file order, in a file sorted by judge."""
    path = work_folder(spark, "keyed")
    rows = judgments(spark, sf_dir).select("question_id", "judge", "answerer", "accuracy")
    files.write_jsonl(rows.orderBy("judge", "answerer", "question_id"), path)
    return files.read_keyed_jsonl(spark, path, "question_id long, judge string, accuracy int", "question_id")


@query("select o_orderkey as id, o_orderstatus as status, count(*) over (partition by o_orderstatus) as n from orders")
def append_and_union(spark, sf_dir):
    """Checkpoint files that grow part by part, and several files read as one."""
    rows, paths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), [work_folder(spark, "part") for _ in range(2)]
    for k in range(4):
        files.write_jsonl(rows.where(F.col("id") % 4 == k), paths[k % 2], append=True)
    back = files.read_jsonl(spark, paths, "id long, status string")
    return back.join(back.groupBy("status").agg(F.count("*").alias("n")), "status").select("id", "status", "n")


@query("select r_name as regulation, n_nationkey::varchar as article_number, n_name as title from nation join region on r_regionkey = n_regionkey where r_name in ('ASIA', 'EUROPE')")
def article_folder(spark, sf_dir):
    """All article files of a folder, one a regulation, of which two are wanted."""
    folder = work_folder(spark, "articles")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    article = F.struct(F.col("r_name").alias("regulation"), F.col("n_nationkey").cast("string").alias("article_number"), F.col("n_name").alias("title"))
    documents = nations.join(regions, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("regulation")).agg(F.collect_list(article).alias("articles"))
    for name in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):
        files.write_json_document(documents.where(F.col("regulation") == name), f"{folder}/{name}_articles.json")
    rows = files.read_articles(spark, folder, "regulation string, articles array<struct<regulation:string,article_number:string,title:string>>", ["ASIA", "EUROPE"])
    return rows.select("regulation", "article_number", "title")


@query(f"with {JUDGMENTS_SQL}, r as (select judge, answerer, count(*) as n, round(avg(accuracy), 6) as accuracy from judgments group by 1, 2) select judge, answerer, n, accuracy, (select count(*) from judgments) as total, (select count(*) from r) as cells from r")
def report_document(spark, sf_dir):
    """A report file with a summary and its results, read back."""
    path, rows = work_folder(spark, "report"), judgments(spark, sf_dir)
    results = rows.groupBy("judge", "answerer").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))
    files.write_report_parts(rows.agg(F.count("*").alias("total")).crossJoin(results.agg(F.count("*").alias("cells"))), results, path)  # one row each
    summary = files.read_report_summary(spark, path, "total long, cells long")
    return files.read_array_parts(spark, path, "judge string, answerer string, n long, accuracy double").crossJoin(summary)  # one row


@query("""with p as (select substr(sha256(o_orderkey::varchar), 1, 3) as part, sha256(string_agg(o_orderkey::varchar, '|' order by o_orderkey::varchar)) as h from orders group by 1)
select sha256(string_agg(h, '|' order by part)) as tree_hash from p""")
def split_tree_hash(spark, sf_dir):
    """A hash of all order ids that is put together from parts."""
    return files.tree_hash(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id")))
