"""JSON in model replies: balanced objects, the first or last valid one, repairs. Arrow-batched Python functions."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

DIMS = ("accuracy", "completeness", "topic_coherence", "citation_quality")
OLD_DIMS = ("accuracy", "completeness", "clarity", "overall")
FENCE = re.compile(r"```(?:json)?")
BRACE = re.compile("[{}]")


def objects(text: str) -> list[str]:
    """Balanced {...} stretches from left to right; quotes are not looked at."""
    braces = list(BRACE.finditer(text))
    # open braces after each one; a closing brace without partner changes nothing
    open_after = list(accumulate((1 if m[0] == "{" else -1 for m in braces), lambda n, step: max(0, n + step), initial=0))
    outer = [m for m, before, after in zip(braces, open_after, open_after[1:], strict=False) if {before, after} == {0, 1}]
    return [text[a.start() : b.end()] for a, b in zip(outer[::2], outer[1::2], strict=False)]


def loaded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def valid(value, dims=DIMS, numeric: bool = True) -> bool:
    """An object with all dimensions, numbers if asked (a boolean counts as one)."""
    return isinstance(value, dict) and all(d in value and (not numeric or isinstance(value[d], (int, float))) for d in dims)


def scores(text: str | None, mode: str) -> str | None:
    """The scores object as JSON text: 'last' (numeric), 'first' (any values), 'flat' (last unnested, old dimensions)."""
    text = FENCE.sub("", text or "")
    if mode == "flat":
        found = [v for x in re.findall(r"\{[^{}]+\}", text) if valid(v := loaded(x), OLD_DIMS, False)]
    else:
        found = [v for x in objects(text) if valid(v := loaded(x), DIMS, mode == "last")]
    if not found:
        return None
    value = found[0] if mode == "first" else found[-1]
    keep = (*(OLD_DIMS if mode == "flat" else DIMS), "reasoning")
    return json.dumps({k: value[k] for k in keep if k in value}, ensure_ascii=False)


def repaired(text: str | None) -> str | None:
    """JSON text of a reply: as it is, outermost braces or brackets, without trailing commas, with double quotes; null if none parses."""
    text = FENCE.sub("", text or "").strip()
    tries = [text]
    for a, b in ("{}", "[]"):
        if a in text and b in text:
            tries.append(text[text.index(a) : text.rindex(b) + 1])
    tries += [re.sub(r",\s*([}\]])", r"\1", x) for x in tries[:]]
    tries += [x.replace("'", '"') for x in tries[:]]
    for x in tries:
        if (v := loaded(x)) is not None:
            return json.dumps(v, ensure_ascii=False, sort_keys=True)
    return None


def scores_udf(mode: str):
    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([scores(t, mode) for t in texts], dtype=object)

    return run


@pandas_udf(StringType())
def repair_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([repaired(t) for t in texts], dtype=object)
