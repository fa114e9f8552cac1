"""Text measures on whole texts, as Columns; counts over many texts as frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .shapes import top_per_group

# Characters stripped from query terms; words of the critic; phrases of the safety gate.
STRIPPED = ".,:;!?()[]{}"
CINEMATIC = ["4k", "cinematic", "lighting", "smooth", "dramatic", "film"]
FORBIDDEN = ["nsfw", "violence", "gore", "explicit"]
HIGH_STAKES = ["diagnosis", "buy stock", "sell stock", "marriage decision", "legal decision", "guaranteed", "certainly", "诊断结论", "买入股票", "卖出股票", "婚姻决策", "法律决策", "保证", "必然"]
BOUNDARIES = [
    ["cultural research", "文化研究"], ["entertainment", "娱乐参考"], ["do not use", "不应用于", "不能替代", "不替代"], ["medical", "医疗"], ["investment", "投资"], ["marriage", "婚姻", "婚恋"],
]

# Tokens of an event's subtype, by marker; the industries of domains.
MARKERS = {
    "release": ["release", "album", "single", "film", "television", "series", "screen", "video", "tour", "publication"],
    "award_or_recognition": ["award", "recognition", "nominated", "winning", "hall_of_fame", "number_one", "record", "title", "prize"],
    "commercial_or_chart": ["chart", "global", "box_office", "ratings", "commercial", "breakthrough_album"],
    "media_or_publicity": ["public", "fame", "media", "broadcast", "attention", "image", "cultural"],
    "competition": ["grand_slam", "slam", "olympic", "medal", "championship", "competition", "ranking", "title", "season", "peak", "comeback"],
    "industry_project": ["contract", "entry", "role", "production", "launch", "debut", "relaunch", "selection", "founding"],
}
INDUSTRIES = {"film_or_television": ["影视", "影视武术"], "music": ["歌手"], "sports": ["体育"]}


def words(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(STRIPPED))), lambda w: w != ""))


def overlap_ratio(wanted: Column, given: Column) -> Column:
    a = words(wanted)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, words(given))) / F.size(a)).otherwise(0.0)


def keyword_score(text: Column, keywords: list[str] | None = None, full: int = 3) -> Column:
    k = F.array(*[F.lit(w) for w in (CINEMATIC if keywords is None else keywords)])
    return F.least(F.lit(1.0), F.size(F.array_intersect(words(text), k)) / full)


def allowed(text: Column, forbidden: list[str] | None = None) -> Column:
    k = F.array(*[F.lit(w) for w in (FORBIDDEN if forbidden is None else forbidden)])
    return F.when(F.arrays_overlap(words(text), k), 0.0).otherwise(1.0)


def gated_total(gate: Column, parts: list[tuple[Column, float]]) -> Column:
    total = sum((w * c for c, w in parts), F.lit(0.0))
    return F.when(gate == 0, 0.0).otherwise(total)


def safety_score(text: Column, extra_ok: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(t, p))
    share = sum((any_of(g).cast("int") for g in BOUNDARIES), F.lit(0)) / len(BOUNDARIES)
    return F.when(any_of(HIGH_STAKES), 0.0).otherwise(F.least(F.lit(1.0), share * 0.8 + F.when(extra_ok, 0.2).otherwise(0.0)))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\x{4e00}-\x{9fff}]"))


def latin_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]"))


def subtype_flags(domain: Column, topic: Column, subtype: Column) -> dict[str, Column]:
    """industry, a flag for each marker (any of its tokens in the subtype; industry projects only of that topic), whether there is
    any of them, and what a domain takes as evidence of fame, of a project or of a peak: null outside that domain."""
    s = F.lower(F.coalesce(subtype, F.lit("")))
    industry = F.lit("general")
    for name, domains in INDUSTRIES.items():
        industry = F.when(domain.isin(domains), name).otherwise(industry)
    has = {k: F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(s, t)) for k, tokens in MARKERS.items()}
    of = lambda t: F.coalesce(topic == t, F.lit(False))
    has["industry_project"] = of("career_project") & has["industry_project"]
    any_ = F.lit(False)
    for c in has.values():
        any_ = any_ | c
    only = lambda name, c: F.when(industry == name, c)
    return {
        "industry": industry, **{f"has_{k}": c for k, c in has.items()}, "has_project": of("career_project"), "has_fame": of("public_fame"), "has_domain_specific": any_,
        "film_fame": only("film_or_television", of("public_fame") & (has["release"] | has["award_or_recognition"] | has["media_or_publicity"])),
        "film_project": only("film_or_television", of("career_project") & (has["release"] | has["award_or_recognition"] | has["industry_project"])),
        "music_fame": only("music", of("public_fame") & (has["commercial_or_chart"] | has["award_or_recognition"] | has["media_or_publicity"])),
        "music_project": only("music", of("career_project") & has["release"]),
        "sports_peak": only("sports", of("sports_peak") & (has["competition"] | has["award_or_recognition"])),
    }


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def duplicate_line_ratio(text: Column, prefix: str = "") -> Column:
    """Share of lines (that begin so) which repeat an earlier one."""
    some = F.filter(lines(text), lambda x: (x != "") & x.startswith(prefix)) if prefix else F.filter(lines(text), lambda x: x != "")
    n = F.size(some)
    return F.when(n > 0, (n - F.size(F.array_distinct(some))) / n).otherwise(0.0)


def tail_bullets(text: Column, sections: int) -> Column:
    """Bullets ("- ") of the last sections ("## "), trimmed, in order."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n## "), 2, 1_000_000)  # what precedes the first heading is none
    tail = F.when(F.size(parts) > sections, F.slice(parts, -sections, sections)).otherwise(parts)
    rows = F.flatten(F.transform(tail, lambda s: F.slice(F.split(s, "\n"), 2, 1_000_000)))
    return F.transform(F.filter(rows, lambda x: x.startswith("- ")), lambda x: F.trim(x))


def markers_ratio(items: Column, markers: list[str]) -> Column:
    """Share of items that hold every marker."""
    def full(x):
        cond = F.lit(True)
        for m in markers:
            cond = cond & F.contains(x, F.lit(m))
        return cond

    return F.when(F.size(items) > 0, F.size(F.filter(items, full)) / F.size(items)).otherwise(0.0)


def error_key(text: Column, n: int = 8) -> Column:
    """The first words, lower-cased: a key for equal failures."""
    return F.lower(F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " "))


def identifier(text: Column) -> Column:
    """Letters and digits lower-cased, all else an underscore each, none at the ends."""
    return F.btrim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")), F.lit("_"))


def retrieve(queries: DataFrame, passages: DataFrame, query_id: str, query_text: str, source: str, passage_id: str, keywords: str, k: int = 2, most_terms: int = 200_000) -> DataFrame:
    """The k passages of each source that share most terms with a query; ties to the greater id.

    Up to most_terms query terms go to the workers as an index of terms; each counts its passages' overlaps where they are and
    hands on its k best of every query and source, so what is exchanged doesn't grow with the passages that share a common
    word. More query terms meet the keywords in an equi-join instead, so only passages that share a term are ever paired."""
    q = queries.select(F.col(query_id).alias("q"), F.explode(terms(F.col(query_text))).alias("term"))
    p = passages.select(F.col(source).alias("s"), F.col(passage_id).alias("p"), F.array_distinct(F.col(keywords)).alias("words"))
    few = q.limit(most_terms + 1).toPandas()
    if len(few) > most_terms:
        hits = p.select("s", "p", F.explode("words").alias("term")).join(q, "term").groupBy("q", "s", "p").agg(F.count("*").alias("overlap"))
    else:
        hits = _local_best(p, few, q, k)
    best = top_per_group(hits, ["q", "s"], [F.col("overlap").desc(), F.col("p").desc()], k)
    return best.select(F.col("q").alias(query_id), F.col("s").alias(source), F.col("p").alias(passage_id), "overlap", "rank")


def _local_best(p: DataFrame, index: pd.DataFrame, q: DataFrame, k: int) -> DataFrame:
    """q, s, p, overlap: each task's k best passages of every query and source. index: q and term. Words are looked up as Arrow
    arrays, overlaps counted as numbers; a task holds k rows for each query and source, and one batch."""
    codes, ids = pd.factorize(index["q"])
    term, words_ = pd.factorize(index["term"])
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(words_) + 1))
    held = p.sparkSession.sparkContext.broadcast((pa.array(words_, pa.string()), codes[order], first, list(ids)))
    schema = StructType([q.schema["q"], p.schema["s"], p.schema["p"], StructField("overlap", LongType())])

    def best_of(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["q", "s", "n", "p"], ascending=[True, True, False, False], kind="stable").groupby(["q", "s"], sort=False, dropna=False).head(k)

    def run(batches):
        listed, posting, start, names = held.value
        kept, kinds = None, None
        for b in batches:
            kinds, lists = b.schema, b.column(2)
            place = pc.index_in(lists.flatten(), value_set=listed)
            found = pc.is_valid(place).to_numpy(zero_copy_only=False)
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[found].astype(np.int64)
            t = place.drop_null().to_numpy(zero_copy_only=False)
            n = start[t + 1] - start[t]
            at = np.repeat(start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pair, count = np.unique(np.repeat(doc, n) * len(names) + posting[at], return_counts=True)
            doc = pair // max(1, len(names))
            rows = pd.DataFrame({"q": pair % max(1, len(names)), "s": b.column(0).take(pa.array(doc)).to_pandas(), "p": b.column(1).take(pa.array(doc)).to_pandas(), "n": count})
            rows = rows[rows["p"].notna()]
            kept = best_of(rows if kept is None else pd.concat([kept, best_of(rows)], ignore_index=True))
        if kept is not None and len(kept):
            q_type = to_arrow_type(schema["q"].dataType)
            columns = [pa.array([names[i] for i in kept["q"]], q_type), pa.array(kept["s"], kinds.field(0).type, from_pandas=True), pa.array(kept["p"], kinds.field(1).type, from_pandas=True), pa.array(kept["n"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "s", "p", "overlap"])

    return p.mapInArrow(run, schema)
