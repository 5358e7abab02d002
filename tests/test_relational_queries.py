"""Every relational query that SQL can state gives DuckDB's rows; the others those of a plain version."""

import math
import re

import pytest

from lexaudit.plans import catalogue
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(name, agree):
    agree(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_typed_numbers(spark):
    blank = re.compile(r"<[^>]*>|@[^@<>]*@|%i:[^%\s]*%|\{\{[^}]*\}\}|&[a-zA-Z]+;|&#\d+;")
    number = re.compile(r"(?<![\w.])(\d+(?:\.\d+)?)(?:\s?%|st|nd|rd|th|x)?(?!\w)")
    want = set()
    for r in table(spark, "documents"):
        plain = blank.sub(lambda m: " " * len(m[0]), r.text or "")
        want |= {(r.doc_id, i, m[0], m.start(), m.end(), float(m[1])) for i, m in enumerate(number.finditer(plain))}
    got = catalogue.QUERIES["typed_numbers"](spark, SF).collect()
    assert {(r.doc_id, r.pos, r.text, r.start, r.end, r.value) for r in got} == want and len(got) == len(want) > 0


def test_sentence_quote(spark):
    def quote(text):
        own = [s for s in re.split(r"(?<=[.!?])\s+", text, flags=re.ASCII) if any(w in s.lower() for w in ("the", "de", "und"))]
        out = " ... ".join(own) if own else text
        return out if len(out) <= 300 else out[:297].rstrip(" ") + "..."

    want = {r.doc_id: None if r.text is None else quote(r.text) for r in table(spark, "documents")}
    assert {r.doc_id: r.quote for r in catalogue.QUERIES["sentence_quote"](spark, SF).collect()} == want


def test_quoted_words(spark):
    def reduced(text):
        quoted = [a or b for a, b in re.findall(r'"([^"]+)"|“([^”]+)”', text or "")]
        raw = re.sub(r"<[^<>]*>", "", re.sub(r"(?i)</?(?:br|li|ul|ol|p|hr|rules)\b[^<>]*>", " ", " ".join(quoted) if quoted else text or ""))
        words = re.sub(r"<[^<>]*$", "", re.sub(r"^[^<>]*>", "", raw)).split()[:8]
        cut = re.sub(r"[.,;:]+$", "", " ".join(words).strip(" ,;:"))
        tokens = dict.fromkeys(re.findall(r"@[^@\s]+@", text or ""))
        return " ".join(tokens) if tokens else '"' + re.sub(r"^\.+(?!\d)", "", cut).strip(" ") + '"'

    want = {(r.conv_id, r.turn): reduced(r.text) for r in table(spark, "conversations")}
    assert {(r.conv_id, r.turn): r.names for r in catalogue.QUERIES["quoted_words"](spark, SF).collect()} == want


def test_xxh64_names(spark):
    import xxhash

    want = {r.n_nationkey: xxhash.xxh64_intdigest(r.n_name) for r in table(spark, "nation")}
    got = {r.n_nationkey: r.hash for r in catalogue.QUERIES["xxh64_names"](spark, SF).collect()}
    assert {k: int(v, 16) for k, v in got.items()} == want


def test_clopper_pearson(spark):
    def tail(k, n, p):
        return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))

    for r in catalogue.QUERIES["clopper_pearson_by_group"](spark, SF).collect():
        assert r.k == 0 and r.lo == 0 or abs(tail(r.k, r.n, r.lo) - 0.025) < 1e-6
        assert r.k == r.n and r.hi == 1 or abs(1 - tail(r.k + 1, r.n, r.hi) - 0.025) < 1e-6
