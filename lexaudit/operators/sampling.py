"""Reproducible sampling: rows are ordered by a hash of seed, purpose and key, which no partitioning changes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.operators.windows import first_per_key


def draw_key(seed: int | str, purpose: str, *key: Column) -> Column:
    """The order of a draw: md5 of ``seed:purpose:key...``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *(k.cast("string") for k in key)))


def sample(rows: DataFrame, n: int, seed: int | str, purpose: str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n rows (all if fewer) of the whole or of each group, without replacement.

    Groups are cut to n before the final choice on every partition, so a large group is not gathered.
    """
    k = draw_key(seed, purpose, *map(F.col, key))
    if not by:
        return rows.withColumn("_k", k).orderBy("_k", *key).limit(n).drop("_k")
    keyed = rows.withColumn("_k", k).withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(64)))
    order = ["_k", *key]
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_k", "_r", "_salt")


def shuffled(rows: DataFrame, seed: int | str, purpose: str, key: Sequence[str]) -> DataFrame:
    return rows.orderBy(draw_key(seed, purpose, *map(F.col, key)), *key)


def near_equal(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def draw_by_quota(candidates: DataFrame, count: int, *, seed: int | str, max_share: float | None = None) -> tuple[DataFrame, list[dict]]:
    """(drawn rows, reallocated) of quota_draw over a table of any size: candidates(rule, id, ability, text), all strings.

    A draw uses up ``count`` abilities and texts at most.  So of each rule's candidates only those can be drawn
    that are first, in hash order, with their ability and text, among the first count + 1 of their ability, and of those of
    their text; and of what is left the first 2 x count x (count + 1) + 1, as no more can be used up before
    one of them.  These are found by Spark and go to the driver: their number follows the draw and its rules, not the table.
    """
    c = candidates.select("rule", F.col("id").cast("string").alias("id"), F.col("ability").cast("string").alias("ability"), F.col("text").cast("string").alias("text"))
    c = c.withColumn("_o", F.md5(F.concat(F.lit(f"{seed}:"), "rule", F.lit(":"), "id")))
    some = first_per_key(c, ["rule", "ability", "text"], ["_o", "id"])
    for keys, most in ((["rule", "ability"], count + 1), (["rule", "text"], count + 1), (["rule"], 2 * count * (count + 1) + 1)):
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "id"))).where(F.col("_n") <= most).drop("_n")
    rows = [r.asDict() for r in some.drop("_o").collect()]
    abilities = {r["rule"]: r["n"] for r in c.groupBy("rule").agg(F.count_distinct("ability").alias("n")).collect()}
    drawn, moved = quota_draw(rows, sorted(abilities), count, seed=seed, max_share=max_share, abilities=abilities)
    spark = candidates.sparkSession
    return spark.createDataFrame([(r["rule"], r["id"], r["ability"], r["text"]) for r in drawn], "rule string, id string, ability string, text string"), moved


def quota_draw(candidates: list[dict], rules: Sequence[str], count: int, *, seed: int | str, max_share: float | None = None, exclude: Sequence = (), abilities: Mapping[str, int] | None = None) -> tuple[list[dict], list[dict]]:
    """(drawn, reallocated): a stratified draw with caps, over a bounded list of candidates on the driver.

    A candidate has rule, id, ability and text.  Every rule has a near-equal quota.  Rules take turns; each
    takes its next candidate in hash order whose ability and text are not used yet.  At most
    floor(max_share x its abilities) of a rule are drawn.  A rule that cannot go on hands what it lacks in
    near-equal parts to those that can; the draw ends when nothing moves.  Drawn rows come in hash order.
    ``abilities`` says how many abilities rules have, if that is not how many the candidates have.
    """
    import hashlib

    order = lambda purpose, x: hashlib.md5(f"{seed}:{purpose}:{x['id']}".encode()).hexdigest()
    banned = {tuple(x) if isinstance(x, (list, tuple)) else x for x in exclude}
    queues = {r: sorted((c for c in candidates if c["rule"] == r and c["ability"] not in banned), key=lambda c: order(r, c)) for r in rules}
    has = abilities or {r: len({c["ability"] for c in queues[r]}) for r in rules}
    cap = {r: int(max_share * has[r]) if max_share is not None else len(queues[r]) for r in rules}
    need = dict(zip(rules, near_equal(count, len(rules)), strict=True))
    got: Counter = Counter()
    used, texts, drawn, moved = set(), set(), [], []

    def able(r: str) -> bool:
        while queues[r] and (queues[r][0]["ability"] in used or queues[r][0]["text"] in texts):
            queues[r].pop(0)
        return bool(queues[r]) and got[r] < cap[r]

    while True:
        progress = False
        for r in rules:
            if got[r] < need[r] and able(r):
                c = queues[r].pop(0)
                used.add(c["ability"])
                texts.add(c["text"])
                drawn.append(c)
                got[r] += 1
                progress = True
        if progress:
            continue
        for r in rules:
            short = need[r] - got[r]
            others = [o for o in rules if o != r and able(o)]
            if short > 0 and others and not able(r):
                need[r] = got[r]
                part = near_equal(short, len(others))
                for o, n in zip(others, part, strict=True):
                    need[o] += n
                moved.append({"from": r, "count": short, "to": {o: n for o, n in zip(others, part, strict=True) if n}, "why": "cap" if got[r] >= cap[r] else "no candidates"})
                progress = True
        if not progress:
            return sorted(drawn, key=lambda c: order("shuffle", c)), moved
