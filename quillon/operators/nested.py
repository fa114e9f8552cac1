"""Nested records: flattening, audits, inventories, fingerprints and hash chains."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shapes import all_failures, in_order


def flatten(records: DataFrame, keys: list[str], items: str, fields: list[str], outer: bool = False) -> DataFrame:
    """A row for each item of an array of structs; with outer also one for a record without items."""
    x = (F.explode_outer if outer else F.explode)(F.col(items)).alias("_i")
    return records.select(*keys, x).select(*keys, *[F.col(f"_i.{f}").alias(f) for f in fields])


def flatten_map(df: DataFrame, keys: list[str], tags: str, key: str, value: str) -> DataFrame:
    """Rows of a map of arrays."""
    return df.select(*keys, F.explode(tags).alias(key, "_v")).select(*keys, key, F.explode("_v").alias(value))


def duplicates(df: DataFrame, id: str) -> DataFrame:
    return df.groupBy(id).agg(F.count("*").alias("n")).where("n > 1")


def audit(df: DataFrame, rules: list[tuple[Column, str]], out: str = "failures") -> DataFrame:
    """df with the names of the rules that each row breaks, and whether it is valid."""
    return df.withColumn(out, all_failures(rules)).withColumn("valid", F.size(out) == 0)


def count_map(df: DataFrame, by: list[str], value: str, out: str = "counts") -> DataFrame:
    """by, and a map of value to its count (values sorted)."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n")).where(F.col(value).isNotNull())
    return c.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value).alias("key"), F.col("_n").alias("value"))))).alias(out))


def inventory(defined: DataFrame, observed: DataFrame, id: str) -> DataFrame:
    """id, defined, observed: what is used without a definition, and the reverse, by one full join of distinct ids."""
    a = defined.select(id).distinct().withColumn("defined", F.lit(True))
    b = observed.groupBy(id).agg(F.count("*").alias("n")).withColumn("observed", F.lit(True))
    return a.join(b, id, "full").select(id, F.coalesce("defined", F.lit(False)).alias("defined"), F.coalesce("observed", F.lit(False)).alias("observed"), F.coalesce("n", F.lit(0)).alias("n"))


def roles(ids: DataFrame, train: DataFrame, holdout: DataFrame, id: str) -> DataFrame:
    """role of each id: holdout before train, else unassigned; overlap where an id is in both; unknown ones only in splits."""
    mark = lambda d, n: d.select(id).distinct().withColumn(n, F.lit(True))
    out = mark(ids, "_known").join(mark(train, "_t"), id, "full").join(mark(holdout, "_h"), id, "full")
    role = F.when(F.col("_h"), "holdout").when(F.col("_t"), "train").otherwise("unassigned")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(id, role.alias("role"), (yes("_t") & yes("_h")).alias("overlap"), (~yes("_known")).alias("unknown"))


def coverage(role_rows: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    out = role_rows.agg(
        n((F.col("role") != "unassigned") & ~F.col("unknown")).alias("assigned"), n((F.col("role") == "unassigned") & ~F.col("unknown")).alias("unassigned"),
        n(F.col("unknown")).alias("unknown"), n(F.col("overlap")).alias("overlap"),
    )
    return out.withColumn("complete", (F.col("unassigned") == 0) & (F.col("unknown") == 0) & (F.col("overlap") == 0))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with sorted names; nulls are left out of the JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])), 256)


def _ascii(text: Column) -> Column:
    r"""Characters from 7F on of JSON text as \\uXXXX, those past FFFF as two."""
    def one(c):
        code = F.ascii(c)
        pair = F.format_string("\\u%04x\\u%04x", F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code % 0x400))
        return F.when(code < 127, c).when(code < 0x10000, F.format_string("\\u%04x", code)).otherwise(pair)

    runs = F.regexp_extract_all(text, F.lit("(?s)[\\x00-\\x7E]+|."), 0)
    return F.when(text.rlike("[^\\x00-\\x7E]"), F.array_join(F.transform(runs, one), "")).otherwise(text)


def _lower(text: Column) -> Column:
    r"""JSON text whose \\u00XX of control characters have small letters, as the json module writes them."""
    out = text
    for code in ("0B", "0E", "0F", *[f"1{x}" for x in "ABCDEF"]):
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*+)\\u00" + code, r"$1\\u00" + code.lower())
    return F.when(text.rlike(r"\\u00[01][A-F]"), out).otherwise(text)


def canonical(columns: dict[str, Column], spaced: bool = False, ascii_only: bool = True) -> Column:
    """A JSON object of the columns by sorted name, nulls included. spaced: ", " and ": " between its parts; ascii_only:
    characters from 7F on escaped. Text, whole numbers and booleans have one form; doubles are written as Spark does."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    parts = []
    for k in sorted(columns):
        value = _lower(F.to_json(F.array(columns[k]), {"ignoreNullFields": "false"}))
        parts += [F.lit(("" if not parts else comma) + json.dumps(k, ensure_ascii=ascii_only) + colon), F.substring(value, 2, 1 << 30).substr(F.lit(1), F.length(value) - 2)]
    text = F.concat(F.lit("{"), *parts, F.lit("}"))
    return _ascii(text) if ascii_only else text


def content_hash(columns: dict[str, Column], spaced: bool = False, ascii_only: bool = True) -> Column:
    """SHA-256 of the canonical JSON: compact and ASCII (receipts), spaced and ASCII (records), compact with all characters
    (stable hashes)."""
    return F.sha2(canonical(columns, spaced, ascii_only), 256)


def keyed_topics(df: DataFrame, topics: list[str], evidence: Column, index: Column, shared: dict[str, Column] | None = None, out: str = "topics") -> DataFrame:
    """df with a map of each topic to a struct of its message, its field, the row's index and the hash of its evidence, and
    shared values."""
    def struct(t):
        extra = [c.cast("string").alias(n) for n, c in (shared or {}).items()]
        return F.struct(F.col(t).cast("string").alias("message"), *extra, index.alias("source_row_index"), F.lit(t).alias("source_field"), F.sha2(evidence, 256).alias("evidence_sha256"))

    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(t) for t in topics]), F.array(*[struct(t) for t in topics])))


# What a manifest must say. Path, rule, its argument.
MANIFEST_RULES: list[tuple[str, str, object]] = [
    ("consent.documented", "true", None), ("consent.scope", "among", ["benchmarking", "quality_validation", "research"]), ("consent.withdrawal_process", "present", None),
    ("privacy.deidentified", "true", None), ("privacy.direct_identifiers_removed", "true", None), ("privacy.retention_policy", "among", ["bounded_archive", "delete_after_study", "user_controlled"]),
    ("external_review.reviewed", "true", None), ("external_review.reviewer", "present", None), ("external_review.review_date", "present", None),
    ("external_review.approval", "among", ["approved_for_audit_only", "approved_for_quality_validation"]), ("external_review.protocol_id", "present", None),
    ("label_collection.source", "among", ["mixed", "reviewer_scored", "self_report"]), ("label_collection.collected_before_analysis", "true", None), ("label_collection.collection_window", "present", None), ("label_collection.adjudication", "present", None),
    ("statistical_plan.hypotheses", "present", None), ("statistical_plan.metrics", "present", None), ("statistical_plan.minimum_sample_size", "at least", 30), ("statistical_plan.pre_registered", "true", None), ("statistical_plan.registration_id", "present", None),
    ("data_split.strategy", "among", ["audit_only", "pre_registered_holdout", "temporal_holdout"]), ("data_split.frozen", "true", None), ("data_split.split_date", "present", None), ("data_split.leakage_controls", "present", None),
]


def manifest_failures(manifest: Column, rules: list[tuple[str, str, object]] | None = None) -> Column:
    """What a manifest (JSON text) breaks, in the rules' order; a section that is no object is one failure of its own. null
    is no object at all."""
    rules = MANIFEST_RULES if rules is None else rules
    checks, sections = [], list(dict.fromkeys(r[0].split(".")[0] for r in rules))
    for section in sections:
        own = path_get(manifest, section)
        is_object = F.coalesce(own.startswith("{"), F.lit(False))
        checks.append(F.when(~is_object, f"{section} must be an object"))
        for path, rule, arg in rules:
            if path.split(".")[0] != section:
                continue
            value = path_get(manifest, *path.split("."))
            if rule == "true":
                good, says = value == "true", "must be true"
            elif rule == "among":
                good, says = value.isin(arg), "must be " + ", ".join(arg[:-1]) + " or " + arg[-1]
            elif rule == "at least":
                good, says = value.rlike("^-?[0-9]+$") & (value.try_cast("bigint") >= arg), f"must be an integer >= {arg}"
            else:
                good, says = ~value.isin("", "false", "0", "null", "[]", "{}"), "is required"
            checks.append(F.when(is_object & ~F.coalesce(good, F.lit(False)), f"{path} {says}"))
    return F.array_compact(F.array(*checks))


def record_failures(records: DataFrame, definitions: DataFrame, birth: tuple[str, ...] = ("birth_date", "birth_time", "gender"), evidence: tuple[str, ...] = ("source", "collected_at", "reviewer_or_method")) -> DataFrame:
    """case_id and failure, a row for each rule that a record breaks: repeated ids, birth fields missing or a name given, no
    labels, labels without definition or of another type, provenance missing. records: case_id, birth (struct with name),
    labels (array of id, type, provenance struct); definitions: id, type (a few rows)."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    case, given = F.col("case_id").cast("string"), lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    twice = duplicates(records, "case_id").select("case_id", say("duplicate case_id: ", case).alias("failure"))
    own = [F.when(~given(F.col(f"birth.{b}")), say("record ", case, f" birth.{b} is required")) for b in birth]
    own.append(F.when(given(F.col("birth.name")), say("record ", case, " birth.name must be omitted for deidentification")))
    own.append(F.when(F.coalesce(F.size("labels"), F.lit(0)) <= 0, say("record ", case, " must include labels")))
    flat = flatten(records, ["case_id"], "labels", ["id", "type", "provenance"]).join(F.broadcast(definitions.select(F.col("id"), F.col("type").alias("_type"))), "id", "left")  # a written list
    about = lambda *rest: say("record ", case, " label ", F.col("id"), *rest)
    p = "provenance"
    of_label = [F.when(F.col("_type").isNull(), about(" has no label definition")), F.when(F.col("_type") != F.col("type"), about(" type ", F.col("type"), " does not match definition ", F.col("_type"))), F.when(F.col(p).isNull(), about(" provenance must be an object"))]
    there = F.col(p).isNotNull()
    of_label += [F.when(there & ~given(F.col(f"{p}.{f}")), about(f" provenance.{f} is required")) for f in evidence]
    of_label.append(F.when(there & ~F.coalesce(F.col(f"{p}.collected_before_analysis"), F.lit(False)), about(" provenance.collected_before_analysis must be true")))
    of_label.append(F.when(there & (F.col("type") == "life_event_outcome") & ~F.coalesce(F.col(f"{p}.audit_only_acknowledged"), F.lit(False)), about(" provenance.audit_only_acknowledged must be true for life_event_outcome")))
    rows = lambda df, checks: df.select("case_id", F.explode(F.array_compact(F.array(*checks))).alias("failure"))
    return twice.unionByName(rows(records, own)).unionByName(rows(flat, of_label))


def split_failures(role_rows: DataFrame) -> DataFrame:
    """failure: ids in both parts, ids of no record, and records in no part, as nested.roles() finds them."""
    why = F.array_compact(F.array(F.when(F.col("unknown"), "unknown"), F.when(F.col("overlap"), "overlap"), F.when((F.col("role") == "unassigned") & ~F.col("unknown"), "unassigned")))
    return role_rows.withColumn("failure", F.explode(why))


def short_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def link(df: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """df with previous and hash: each entry's hash is that of the hash before it in its log and its payload (null as
    nothing). A hash needs the one before, so a log is read in order by one task, which holds one entry at a time."""
    from hashlib import sha256

    def entry(state: str, row: dict) -> tuple[str, dict]:
        own = sha256(f"{state}|{row[payload]}".encode() if row[payload] is not None else state.encode()).hexdigest()
        return own, {"previous": state, "hash": own}

    return in_order(df.withColumn(payload, F.col(payload).cast("string")), by, order, [payload], "previous string, hash string", lambda: "", entry)


def path_get(value: Column, *keys: str) -> Column:
    """What lies under keys in JSON text, as text; null where a key is missing or something on the way is no object."""
    return F.get_json_object(value, "$" + "".join(f"['{k}']" for k in keys))


def chain(df: DataFrame, by: list[str], order: str, payload: Column, previous: str, own: str) -> DataFrame:
    """df with ok: the stored hash is that of previous hash and payload, and previous is the hash of the row before. Rows
    without a hash are legacy: they pass and begin the chain anew."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.lag(own).over(w), F.lit(""))
    good = (F.col(previous) == before) & (F.col(own) == F.sha2(F.concat_ws("|", F.col(previous), payload), 256))
    return df.withColumn("ok", F.col(own).isNull() | F.coalesce(good, F.lit(False)))


def bindings(json: DataFrame, column: str, fields: list[str], date: str = "date") -> DataFrame:
    """Rows of a query result in JSON (results.bindings[]): position, the fields' values, and the year of the date; rows
    without a readable year are dropped."""
    names = [*fields, date]
    schema = "results struct<bindings: array<struct<" + ", ".join(f"`{x}`: struct<value: string>" for x in names) + ">>>"
    rows = json.select(F.posexplode(F.from_json(F.col(column), schema).getField("results").getField("bindings")).alias("pos", "b"))
    year = F.substring(F.col(f"b.{date}.value"), 1, 4).try_cast("int")
    return rows.select("pos", *[F.col(f"b.{n}.value").alias(n) for n in fields], year.alias("year")).where("year is not null")


def unpivot(df: DataFrame, keys: list[str], columns: list[str], key: str = "topic", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, key, value)


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Named booleans over the whole frame, and all of them together."""
    out = df.agg(*[F.coalesce(F.bool_and(c), F.lit(False)).alias(n) for n, c in rules.items()])
    together = F.lit(True)
    for n in rules:
        together = together & F.col(n)
    return out.withColumn("accepted", together)
