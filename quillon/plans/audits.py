"""Manifests, canonical hashes, gates, one-sided scores, relations of pairs, universes and keyed topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dsl, registry
from ..operators import calendars, calibration, nested, shapes, texts
from ..sources import panels, readers
from .base import SUPPLIER_MONTH, USER_DAY, query, rounded, table
from .relational import _TAGGED, tagged

# --- manifests -------------------------------------------------------------------------------------------------------

#: A manifest for each part: sections and values vary with the key, so that every rule holds for some and fails for others.
_FIELDS = {
    "consent": [("documented", "p_partkey % 3 <> 0"), ("scope", "case p_partkey % 4 when 0 then 'research' when 1 then 'sales' else 'benchmarking' end"), ("withdrawal_process", "case when p_partkey % 5 <> 0 then p_brand else '' end")],
    "privacy": [("deidentified", "p_partkey % 2 = 0"), ("direct_identifiers_removed", "true"), ("retention_policy", "case when p_size > 10 then 'bounded_archive' else 'forever' end")],
    "external_review": [("reviewed", "p_partkey % 7 <> 0"), ("reviewer", "p_name"), ("review_date", "'2024-01-01'"), ("approval", "case when p_size > 25 then 'approved_for_audit_only' end"), ("protocol_id", "p_type")],
    "label_collection": [("source", "'mixed'"), ("collected_before_analysis", "p_partkey % 11 <> 0"), ("collection_window", "'a year'"), ("adjudication", "'two readers'")],
    "statistical_plan": [("hypotheses", "p_type"), ("metrics", "'recall'"), ("minimum_sample_size", "p_size"), ("pre_registered", "true"), ("registration_id", "'r1'")],
    "data_split": [("strategy", "'audit_only'"), ("frozen", "p_partkey % 13 <> 0"), ("split_date", "'2024-02-01'"), ("leakage_controls", "'by case'")],
}


def _manifest_sql() -> str:
    checks = []
    for section in dict.fromkeys(r[0].split(".")[0] for r in nested.MANIFEST_RULES):
        there = "p_partkey % 17 <> 0" if section == "privacy" else "true"
        checks.append(f"case when not ({there}) then '{section} must be an object' end")
        values = dict(_FIELDS[section])
        for path, rule, arg in nested.MANIFEST_RULES:
            if path.startswith(section + "."):
                v = f"({values[path.split('.')[1]]})"
                if rule == "true":
                    good, says = v, "must be true"
                elif rule == "among":
                    good, says = f"{v} in ({', '.join(repr(a) for a in arg)})", "must be " + ", ".join(arg[:-1]) + " or " + arg[-1]
                elif rule == "at least":
                    good, says = f"{v} >= {arg}", f"must be an integer >= {arg}"
                else:
                    good, says = f"{v} <> ''", "is required"
                checks.append(f"case when ({there}) and not coalesce({good}, false) then '{path} {says}' end")
    return f"select p_partkey, array_to_string(list_filter([{', '.join(checks)}], lambda x: x is not null), '; ') as failures from part"


@query("nested_manifest", _manifest_sql())
def manifest(spark, sf_dir):
    """Every rule's message, in order, of a nested manifest in JSON; one section is missing now and then."""
    sections = [F.expr(f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields)})").alias(name) for name, fields in _FIELDS.items()]
    p = table(spark, sf_dir, "part").select("p_partkey", *sections).withColumn("privacy", F.when(F.col("p_partkey") % 17 != 0, F.col("privacy")))
    out = p.select("p_partkey", nested.manifest_failures(F.to_json(F.struct(*_FIELDS))).alias("f"))
    return out.select("p_partkey", F.array_join("f", "; ").alias("failures"))


# Fixed values of the query: the defined labels.
LABELS = [("1-URGENT", "O"), ("2-HIGH", "O"), ("3-MEDIUM", "F"), ("5-LOW", "life_event_outcome")]

_DEFS = ", ".join(f"('{a}', '{b}')" for a, b in LABELS)


@query("nested_record_failures", f"""with d(id, dtype) as (values {_DEFS}), c as (select c_custkey as case_id, case when c_custkey % 7 <> 0 then c_mktsegment end as birth_date, case when c_custkey % 11 <> 0 then c_name end as birth_time, case when c_acctbal > 0 then 'x' else '' end as gender, case when c_custkey % 50 = 0 then c_name end as name from customer),
 l as (select o_custkey as case_id, o_orderpriority as id, case when o_orderpriority = '5-LOW' then 'life_event_outcome' else o_orderstatus end as type, o_orderkey as k, o_orderkey % 9 = 0 as gone, case when o_orderkey % 4 <> 0 then 's' end as source, '2024' as collected_at, o_comment_ as reviewer_or_method, o_orderkey % 5 <> 0 as before_, o_orderkey % 2 = 0 as ack from (select *, 'r' as o_comment_ from orders) join c on c_custkey_ = o_custkey),
 f as (
  select case_id, 'record ' || case_id || ' birth.birth_date is required' as failure from c where birth_date is null union all select case_id, 'record ' || case_id || ' birth.birth_time is required' from c where coalesce(birth_time, '') = ''
  union all select case_id, 'record ' || case_id || ' birth.gender is required' from c where coalesce(gender, '') = '' union all select case_id, 'record ' || case_id || ' birth.name must be omitted for deidentification' from c where coalesce(name, '') <> ''
  union all select case_id, 'record ' || case_id || ' must include labels' from c where case_id not in (select case_id from l)
  union all select case_id, 'record ' || case_id || ' label ' || id || ' has no label definition' from l where id not in (select id from d)
  union all select case_id, 'record ' || case_id || ' label ' || l.id || ' type ' || type || ' does not match definition ' || dtype from l join d on d.id = l.id where type <> dtype
  union all select case_id, 'record ' || case_id || ' label ' || id || ' provenance must be an object' from l where gone
  union all select case_id, 'record ' || case_id || ' label ' || id || ' provenance.source is required' from l where not gone and source is null
  union all select case_id, 'record ' || case_id || ' label ' || id || ' provenance.collected_before_analysis must be true' from l where not gone and not before_
  union all select case_id, 'record ' || case_id || ' label ' || id || ' provenance.audit_only_acknowledged must be true for life_event_outcome' from l where not gone and type = 'life_event_outcome' and not ack)
 select case_id, failure, count(*) as n from f group by 1, 2""".replace("from c_custkey_", "").replace("join c on c_custkey_ = o_custkey", "where o_custkey in (select case_id from c)"))
def record_failures(spark, sf_dir):
    """Customers as cases, orders as their labels; a failure is listed as often as it occurs."""
    o = table(spark, sf_dir, "orders")
    text = lambda x: F.lit(x)
    made = F.struct(F.when(F.col("o_orderkey") % 4 != 0, "s").alias("source"), text("2024").alias("collected_at"), text("r").alias("reviewer_or_method"), (F.col("o_orderkey") % 5 != 0).alias("collected_before_analysis"), (F.col("o_orderkey") % 2 == 0).alias("audit_only_acknowledged"))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "life_event_outcome").otherwise(F.col("o_orderstatus"))
    label = F.struct(F.col("o_orderpriority").alias("id"), kind.alias("type"), F.when(F.col("o_orderkey") % 9 != 0, made).alias("provenance"))
    labels = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_list(label).alias("labels"))
    k = F.col("c_custkey")
    birth = F.struct(F.when(k % 7 != 0, F.col("c_mktsegment")).alias("birth_date"), F.when(k % 11 != 0, F.col("c_name")).alias("birth_time"), F.when(F.col("c_acctbal") > 0, "x").otherwise("").alias("gender"), F.when(k % 50 == 0, F.col("c_name")).alias("name"))
    records = table(spark, sf_dir, "customer").select(k.alias("case_id"), birth.alias("birth")).join(labels, "case_id", "left")
    found = nested.record_failures(records, spark.createDataFrame(LABELS, "id string, type string"))
    return found.groupBy("case_id", "failure").agg(F.count("*").alias("n"))


# --- hashes ----------------------------------------------------------------------------------------------------------

#: A string as JSON: {plain} are the characters that stand as they are.
_QUOTED = """'"' || coalesce(array_to_string([case when regexp_full_match(c, '(?s)[{plain}]+') then c when c = '"' then '\\"' when c = '\\' then '\\\\' when c = chr(8) then '\\b' when c = chr(9) then '\\t' when c = chr(10) then '\\n' when c = chr(12) then '\\f' when c = chr(13) then '\\r' when unicode(c) < 65536 then '\\u' || printf('%04x', unicode(c)) else '\\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\\u' || printf('%04x', 56320 + unicode(c) % 1024) end for c in regexp_extract_all({x}, '(?s)[{plain}]+|.')], ''), '') || '"'"""
_ASCII, _ANY = " !#-\\[\\]-~", " !#-\\[\\]-\\x{10FFFF}"
_JSON = """'"doc_id"{s}' || doc_id || '{c}"lang"{s}' || coalesce({lang}, 'null') || '{c}"text"{s}' || coalesce({text}, 'null')"""


def _hash_sql() -> str:
    quoted = ", ".join(f"case when {x} is not null then {_QUOTED.replace('{x}', x).replace('{plain}', plain)} end as {x}_{name}" for x in ("lang", "text") for name, plain in (("ascii", _ASCII), ("any", _ANY)))
    forms = [("tight", "ascii", ",", ":"), ("wide", "ascii", ", ", ": "), ("stable", "any", ",", ":")]
    made = ", ".join(f"sha256('{{' || {_JSON.format(c=c, s=s, lang=f'lang_{n}', text=f'text_{n}')} || '}}') as {x}" for x, n, c, s in forms)
    return f"with d as (select doc_id, lang, nullif(text, '') as text from documents), q as (select doc_id, {quoted} from d), h as (select doc_id, {made} from q) select doc_id, tight as receipt, wide as record, stable from h"


@query("nested_canonical_hash", _hash_sql())
def canonical_hash(spark, sf_dir):
    """The three written forms of one object, of whole texts in any characters; on ASCII texts two of them agree."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif("text", F.lit("")).alias("text"))
    c = {x: F.col(x) for x in ("doc_id", "lang", "text")}
    return d.select("doc_id", nested.content_hash(c).alias("receipt"), nested.content_hash(c, spaced=True).alias("record"), nested.content_hash(c, ascii_only=False).alias("stable"))


@query("nested_path_get", "select event_id, props->>'k' as k, (props->'k'->>'none') as below, props->>'nothing' as nothing from events")
def path_get(spark, sf_dir):
    """Along keys: a value, below a scalar, and a missing key."""
    e, p = table(spark, sf_dir, "events"), F.col("props")
    return e.select("event_id", nested.path_get(p, "k").alias("k"), nested.path_get(p, "k", "none").alias("below"), nested.path_get(p, "nothing").alias("nothing"))


@query("nested_keyed_topics", """with e as (select doc_id, lang, source, n_chars::varchar as size, row_number() over (order by doc_id) - 1 as i from documents)
 select doc_id, topic, m as message, i as source_row_index, topic as source_field, sha256(lang || '|' || source) as evidence_sha256 from (select doc_id, lang, source, i, unnest(['lang', 'size']) as topic, unnest([lang, size]) as m from e)""")
def keyed_topics(spark, sf_dir):
    """A map of topics to structs, read back as rows; the index is a stored column."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("size"))
    indexed = shapes.ranked(d, -F.col("doc_id"), [], "i").withColumn("i", (F.col("i") - 1).cast("bigint"))
    made = nested.keyed_topics(indexed, ["lang", "size"], F.concat_ws("|", "lang", "source"), F.col("i"))
    return made.select("doc_id", F.explode("topics").alias("topic", "v")).select("doc_id", "topic", "v.message", "v.source_row_index", "v.source_field", "v.evidence_sha256")


# --- gates and scores ------------------------------------------------------------------------------------------------


@query("calibration_one_sided", f"with {_TAGGED} select case_id, topic, year, case when is_event then hit end as exact_match, case when is_event then strict end as strict_exact_match, case when not is_event then hit end as false_positive, case when not is_event then strict end as strict_false_positive from g")
def one_sided(spark, sf_dir):
    out = calibration.one_sided(tagged(spark, sf_dir))
    return out.select("case_id", "topic", "year", "exact_match", "strict_exact_match", "false_positive", "strict_false_positive")


@query("calibration_readiness", """select l.doc_id, d.source as profile_source, d.lang as profile_rating, array_to_string(list_filter([case when d.doc_id is null then 'missing reviewed profile' end, case when not coalesce(toxic in (0, 1), false) then 'toxic is not boolean' end,
 case when not coalesce(quality = 1, false) then 'quality is too low' end], lambda x: x is not null), '; ') as reasons, d.doc_id is not null and coalesce(toxic in (0, 1), false) and coalesce(quality = 1, false) as scoring_ready from labels l left join (select doc_id, min(source) as source, min(lang) as lang from documents where lang <> 'fr' group by 1) d using (doc_id)""")
def readiness(spark, sf_dir):
    """Labels against the profiles of their documents (those in one language have none), with what blocks them."""
    d = table(spark, sf_dir, "documents").where("lang <> 'fr'").select("doc_id", "source", F.col("lang").alias("rating"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    out = calibration.readiness(lab, d, "doc_id", {"toxic is not boolean": F.col("toxic").isin(0, 1), "quality is too low": F.col("quality") == 1})
    return out.select("doc_id", "profile_source", "profile_rating", F.array_join("blocking_reasons", "; ").alias("reasons"), "scoring_ready")


@query("calibration_acceptance", """with s as (select avg(value) filter (event_type = 'view') as b, avg(value) filter (event_type = 'click') as s, avg(value) filter (event_type = 'error') as v, min(value) filter (event_type = 'click') > 0 as f, min(value) filter (event_type = 'error') > 1 as vf from events),
 g as (select *, true as r, s > b as i, v >= b as n from s)
 select r as regression_gate, f as metric_floors, i as train_score_improved, vf as validation_metric_floors, n as validation_score_not_regressed, r and f and i and vf and n as accepted,
 array_to_string(list_filter([case when not f then 'selected candidate failed metric floors' end, case when not i then 'selected train score ' || printf('%.3f', s) || ' did not exceed baseline ' || printf('%.3f', b) end, case when not vf then 'validation candidate failed metric floors' end,
 case when not n then 'validation score ' || printf('%.3f', v) || ' below baseline ' || printf('%.3f', b) end], lambda x: x is not null), '; ') as reasons from g""")
def acceptance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = lambda kind, least: e.where(F.col("event_type") == kind).agg(F.avg("value").alias("average_score"), (F.min("value") > least).alias("passed_floors"), F.lit(True).alias("passed_regression"))
    return calibration.acceptance(mean("view", 0), mean("click", 0), mean("error", 1))


@query("calibration_vote_partition", "with v as (select user_id, event_type, avg(value) as s from events group by 1, 2) select user_id, round(avg((s >= 20)::int::double), 6) as support, coalesce(string_agg(case when s >= 20 then event_type end, ',' order by event_type), '') as in_favour, coalesce(string_agg(case when s < 20 then event_type end, ',' order by event_type), '') as against from v group by 1")
def vote_partition(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("s"))
    out = calibration.partition_votes(v, ["user_id"], "event_type", "s", 20.0)
    return rounded(out.select("user_id", "support", F.array_join("in_favour", ",").alias("in_favour"), F.array_join("against", ",").alias("against")))


@query("calibration_cases_by_domain_topic", f"with {_TAGGED} select domain, topic, count(distinct case_id) as cases, string_agg(distinct case_id::varchar, ',' order by case_id::varchar) as case_ids from g where is_event group by 1, 2")
def cases_by_domain_topic(spark, sf_dir):
    """How many cases, and which, have an event."""
    g = tagged(spark, sf_dir).where("is_event").select("domain", "topic", F.col("case_id").cast("string").alias("c"))
    return g.groupBy("domain", "topic").agg(F.count_distinct("c").alias("cases"), F.array_join(F.array_sort(F.collect_set("c")), ",").alias("case_ids"))


# --- rankings and universes ------------------------------------------------------------------------------------------


@query("rank_two_metrics", "with c as (select c_mktsegment as universe, c_custkey as factor, c_acctbal as sharpe, coalesce(t, 0) as ic from customer left join (select o_custkey, sum(o_totalprice) as t from orders group by 1) on o_custkey = c_custkey), u as (select universe, factor, 'sharpe' as metric, sharpe as value from c union all select universe, factor, 'ic', ic from c) select universe, metric, row_number() over (partition by universe, metric order by value desc, factor)::int as rank, factor, round(value, 4) as value from u qualify rank <= 10")
def two_metrics(spark, sf_dir):
    """The ten best of each universe by either metric."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("ic"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("universe"), "c_custkey", F.col("c_acctbal").alias("sharpe")).join(o, "c_custkey", "left").fillna(0.0, ["ic"])
    best = shapes.top_by_metrics(c, ["universe"], ["sharpe", "ic"], [F.col("c_custkey")], 10)
    return best.select("universe", "metric", "rank", F.col("c_custkey").alias("factor"), F.round("value", 4).alias("value"))


@query("universe_major", f"with {SUPPLIER_MONTH}, m as (select symbol from (select distinct symbol, market_cap from p) order by market_cap desc nulls last, symbol limit 5) select symbol, date, close from p where symbol in (select symbol from m)")
def universe_major(spark, sf_dir):
    """The panel of the five largest symbols by market cap."""
    return readers.universe(panels.supplier_month(spark, sf_dir), top=5).select("symbol", "date", "close")


@query("universe_sector", f"with {SUPPLIER_MONTH} select symbol, date, close from p where regexp_matches(coalesce(sector, ''), '^1|7')")
def universe_sector(spark, sf_dir):
    return readers.universe(panels.supplier_month(spark, sf_dir), keywords=["^1", "7"]).select("symbol", "date", "close")


# --- calendars -------------------------------------------------------------------------------------------------------

_ST, _BR, _EL, _MA, _BE = (str(x) for x in (calendars.STEMS, calendars.BRANCHES, calendars.ELEMENTS, calendars.MANSIONS, calendars.BRANCH_ELEMENTS))


@query("calendar_mansions", f"select d::date as date, ({_MA})[(n % 28 + 28) % 28 + 1] as mansion, h::int as hour, ({_ST})[((n * 2 + ((h + 1) // 2) % 12) % 10 + 10) % 10 + 1] || ({_BR})[((h + 1) // 2) % 12 + 1] as hour_label from (select d, (d::date - date '1984-02-02')::bigint as n from generate_series(timestamp '1983-12-20', timestamp '1984-06-30', interval 1 day) t(d)), range(0, 24) u(h)")
def mansions(spark, sf_dir):
    """The cycle of twenty-eight and the stem and branch of each hour."""
    d = calendars.days(spark, "1983-12-20", "1984-06-30").select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return d.select("date", calendars.mansion(F.col("date")).alias("mansion"), "hour", calendars.hour_label(F.col("date"), F.col("hour")).alias("hour_label"))


_REL = ", ".join(f"('{r}', '{a}', '{b}')" for r, pairs in calendars.RELATIONS.items() for a, b in pairs)


@query("calendar_relations", f"with r(relation, a, b) as (values {_REL}), y as (select y, ({_BR})[((y - 1984) % 12 + 12) % 12 + 1] as branch from range(1950, 2051) t(y)), n(pillar, natal) as (values ('year', 'Zi'), ('month', 'Hai'), ('day', 'Yin'), ('hour', 'Chen')) select y::int as year, pillar, branch, natal, relation from y, n, r where (branch = a and natal = b) or (branch = b and natal = a)")
def relations(spark, sf_dir):
    """How each year's branch stands to four natal ones."""
    y = calendars.years(spark, 1950, 2050).withColumn("branch", calendars.cycle(calendars.BRANCHES, F.col("year") - 1984))
    n = spark.createDataFrame([("year", "Zi"), ("month", "Hai"), ("day", "Yin"), ("hour", "Chen")], "pillar string, natal string")
    return calendars.relations(y.crossJoin(F.broadcast(n)), "branch", "natal").select("year", "pillar", "branch", "natal", "relation")  # four rows


# Fixed values of the query: a natal chart.
NATAL, DOMINANT, USEFUL = {"Wood": 3, "Fire": 1, "Earth": 2, "Metal": 0, "Water": 2}, "Wood", "Metal"
_N = "case e when " + " when ".join(f"'{k}' then {v}" for k, v in NATAL.items()) + " end"
_CAT = "case focus when " + " when ".join(f"'{k}' then '{v}'" for k, v in calendars.CATEGORIES.items()) + " end"


@query("calendar_intensity", f"""with y as (select y, [({_EL})[(((y - 1984) % 10 + 10) % 10) // 2 + 1], ({_BE})[((y - 1984) % 12 + 12) % 12 + 1]] as a from range(1950, 2051) t(y)), c as (select y, a, e, i, len(list_filter(a, lambda x: x = e)) as n, {_N} as m from y, (select unnest({_EL}) as e, unnest(range(5)) as i)),
 f as (select y, any_value(a) as a, case when list_contains(any_value(a), '{USEFUL}') then '{USEFUL}' else first(e order by n desc, m, i) end as focus from c group by 1), g as (select *, len(list_filter(a, lambda x: x = '{DOMINANT}')) = 2 as twice, list_contains(a, '{USEFUL}') as good from f)
 select y::int as year, focus, {_CAT} as category, case when twice then 'high-volatility' when good then 'constructive' when list_contains(a, '{DOMINANT}') then 'active' else 'moderate' end as intensity,
 case when twice then 'dominant_element_reinforced' when focus = '{USEFUL}' then 'useful_element_activated' when good then 'useful_element_present' else 'neutral_or_indirect' end as useful_state from g""")
def intensity(spark, sf_dir):
    """The element that a year stands for, its category, and the ordered rules for intensity and useful state."""
    i = F.col("year") - 1984
    y = calendars.years(spark, 1950, 2050).withColumn("a", F.array(calendars.stem_element(i), calendars.branch_element(i)))
    natal = F.map_from_arrays(F.array(*[F.lit(k) for k in NATAL]), F.array(*[F.lit(v) for v in NATAL.values()]))
    dominant, useful, a = F.lit(DOMINANT), F.lit(USEFUL), F.col("a")
    y = y.withColumn("focus", calendars.focus_element(a, natal, useful))
    return y.select("year", "focus", calendars.category(F.col("focus")).alias("category"), calendars.intensity(a, dominant, useful).alias("intensity"), calendars.useful_state(F.col("focus"), a, useful, dominant).alias("useful_state"))


@query("text_index_hash", "with r as (select doc_id, lang, sha256('{\"doc_id\": ' || doc_id || ', \"lang\": ' || to_json(lang)::varchar || '}') as h from documents) select lang as source_id, count(*) as record_count, sha256(string_agg(h, '' order by doc_id, h)) as content_hash from r group by 1")
def index_hash(spark, sf_dir):
    """Records and a hash over all of them by source: row hashes first, so what is gathered is 32 bytes a row."""
    r = table(spark, sf_dir, "documents").select("doc_id", "lang", nested.content_hash({"doc_id": F.col("doc_id"), "lang": F.col("lang")}, spaced=True).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), "")
    return r.groupBy(F.col("lang").alias("source_id")).agg(F.count("*").alias("record_count"), F.sha2(whole, 256).alias("content_hash"))


# --- registries and codecs -------------------------------------------------------------------------------------------


@query("dsl_codec", f"with {USER_DAY} select symbol, date, round((close - open) / nullif(high - low + 0.001, 0), 6) + 0.0 as value from p")
def codec(spark, sf_dir):
    """A formula that went through its JSON form and back."""
    node = dsl.from_json(dsl.to_json(dsl.parse("div(sub(close, open), add(sub(high, low), 0.001))")))
    return rounded(dsl.evaluate(panels.user_day(spark, sf_dir), {"value": node}).select("symbol", "date", "value"))


@query("registry_pipeline", "select event_type, count(*) as n, round(sum(value * 2), 4) as total from events where value > 5 group by 1")
def registry_pipeline(spark, sf_dir):
    """Registered transforms in order."""
    registry.transform("above_five")(lambda df: df.where("value > 5"))
    registry.transform("doubled")(lambda df: df.withColumn("value", F.col("value") * 2))
    return registry.pipeline(table(spark, sf_dir, "events"), ["above_five", "doubled"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("registry_scored", "select doc_id, round((0.75 * coalesce((lang = 'en')::int, 0) + 0.25 * contains(lower(source), 'en')::int) / 1.0, 6) as score, (0.75 * coalesce((lang = 'en')::int, 0) + 0.25 * contains(lower(source), 'en')::int) + 1e-9 >= 0.7 as passed from (select doc_id, lang, source || lang as source from documents)")
def registry_scored(spark, sf_dir):
    """Weighted registered metrics: the built-in equality, and one that a caller adds."""
    registry.metric("names_language")(lambda a, b: F.contains(F.lower(F.col("tag")), b).cast("double"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("source", "lang").alias("tag"), F.lit("en").alias("want"))
    out = registry.scored(d, {"exact_match": 0.75, "names_language": 0.25}, "lang", "want", 0.7)
    return rounded(out.select("doc_id", "score", "passed"))


@query("source_synthetic", "select 20::bigint as symbols, 50::bigint as days, 1000::bigint as rows, true as ordered, true as weekdays, 20::bigint as without_return, true as repeats")
def synthetic(spark, sf_dir):
    """What the random panel promises: its size, prices inside the day's range, business days, one row without a return for
    each symbol, and the same values from the same seed."""
    p, again = panels.synthetic(spark, 20, 50, seed=5), panels.synthetic(spark, 20, 50, seed=5).repartition(7)
    same = p.select("symbol", "date", "close").exceptAll(again.select("symbol", "date", "close")).agg((F.count("*") == 0).alias("repeats"))
    inside = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    out = p.agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("days"), F.count("*").alias("rows"), F.bool_and(inside).alias("ordered"), F.bool_and(~F.dayofweek("date").isin(1, 7)).alias("weekdays"), F.count(F.when(F.col("return").isNull(), 1)).alias("without_return"))
    return out.crossJoin(F.broadcast(same))  # one row each


# --- subtypes --------------------------------------------------------------------------------------------------------

# Fixed values of the query.
SUBTYPES = ["Film_release", "olympic_medal", "breakthrough_album", "contract", "hall_of_fame", "nothing", "public_image", "world_tour", "title_defence", "debut", "box_office", "season_opening"]
DOMAINS, TOPICS = ["影视", "歌手", "体育", "商业", "影视武术"], ["career_project", "public_fame", "sports_peak"]


def _subtype_sql() -> str:
    has = {k: "(" + " or ".join(f"contains(s, '{t}')" for t in tokens) + ")" for k, tokens in texts.MARKERS.items()}
    has["industry_project"] = f"(topic = 'career_project' and {has['industry_project']})"
    industry = " ".join(f"when domain in ({', '.join(repr(d) for d in ds)}) then '{n}'" for n, ds in texts.INDUSTRIES.items())
    flags = ", ".join(f"{c} as has_{k}" for k, c in has.items())
    one = lambda name, cond: f"case when industry = '{name}' then {cond} end"
    return f"""with e as (select event_id, ({DOMAINS})[event_id % 5 + 1] as domain, ({TOPICS})[event_id % 3 + 1] as topic, lower(({SUBTYPES})[event_id % 12 + 1]) as s from events),
 f as (select *, case {industry} else 'general' end as industry, {flags}, topic = 'career_project' as has_project, topic = 'public_fame' as has_fame, {' or '.join(has.values())} as has_domain_specific from e)
 select event_id, industry, {', '.join(f'has_{k}' for k in has)}, has_project, has_fame, has_domain_specific, {one('film_or_television', "topic = 'public_fame' and (has_release or has_award_or_recognition or has_media_or_publicity)")} as film_fame,
 {one('film_or_television', "topic = 'career_project' and (has_release or has_award_or_recognition or has_industry_project)")} as film_project, {one('music', "topic = 'public_fame' and (has_commercial_or_chart or has_award_or_recognition or has_media_or_publicity)")} as music_fame,
 {one('music', "topic = 'career_project' and has_release")} as music_project, {one('sports', "topic = 'sports_peak' and (has_competition or has_award_or_recognition)")} as sports_peak from f"""


@query("text_subtype_flags", _subtype_sql())
def subtype_flags(spark, sf_dir):
    """Markers of an event's subtype, and what its domain makes of them."""
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", pick(DOMAINS, 5).alias("domain"), pick(TOPICS, 3).alias("topic"), pick(SUBTYPES, 12).alias("subtype"))
    return e.select("event_id", *[c.alias(k) for k, c in texts.subtype_flags(F.col("domain"), F.col("topic"), F.col("subtype")).items()])
