"""The registered queries over the driver's tables, each with the SQL that says the same.

``documents`` become files ``source/lang/doc_id``; a document's date is derived from
doc_id; folder rules and the register are literals, so that SQL can restate them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions import checks, dates, phrases
from ..functions import text as tx
from ..operators import comply, detect, freshness, fuse, register, registry, rules, score
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("document_id"), "text", "doc_id", "source", "lang")


#: Rules that SQL engines with other dialects can restate.
BY_ID = {r.rule_id: r for r in config.DEFAULT_RULES}
SHARED = tuple(BY_ID[k] for k in ("credit_card", "ip_address", "iban", "italian_id", "swiss_avs"))
#: The email rule without look-ahead, for engines that have none; the same spans on tables like these.
EMAIL_SQL = r"\b([\w\-][\w\-.]*[^.])(@\w+)(\.\w+(\.\w+)?[^.\W])\b"


def _pattern(rule_id: str) -> str:
    return EMAIL_SQL if rule_id == "email" else BY_ID[rule_id].pattern


def _found(rule_id: str, col: str = "text") -> str:
    return f"regexp_extract_all({col}, '{_pattern(rule_id)}')"


ALL_FOUND = " union all ".join(f"select doc_id, source, lang, '{r.pii_type}' as pii_type, {r.base_confidence}::double as confidence, unnest({_found(r.rule_id)}) as value from documents" for r in config.DEFAULT_RULES)
DOC_ID = "source || '/' || lang || '/' || doc_id"


def spans_sql(rule_id: str, src: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    """Offsets by cumulated lengths of the gaps and matches, as rows."""
    return f"""
    select {key}, start, value, '{BY_ID[rule_id].pii_type}' as pii_type from (
      select {key}, unnest(range(len(m))) as i, m, g,
        (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::int as start, rtrim(m[i + 1], ' ') as value
      from (select {key}, {_found(rule_id, col)} as m, regexp_split_to_array({col}, '{_pattern(rule_id)}') as g from {src}))"""


# --- detection --------------------------------------------------------------------------


def found_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, pii_type, confidence, value`` of all rules."""
    c = documents(spark, sf_dir).select("doc_id", "source", "lang", detect.rule_candidates("text").alias("c"))
    return detect.explode_candidates(c, "c").select("doc_id", "source", "lang", "pii_type", "confidence", F.col("text").alias("value"), "start", "end", "ord")


@query("regex_inventory", f"select pii_type, count(*) as n from ({ALL_FOUND}) group by pii_type")
def regex_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_values(spark, sf_dir).groupBy("pii_type").agg(F.count("*").alias("n"))


def _spans_query(rule_id: str) -> None:
    @query(f"regex_spans_{rule_id}", spans_sql(rule_id))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").select(F.col("doc_id"), detect.rule_candidates("text", [BY_ID[rule_id]]).alias("c"))
        return detect.explode_candidates(d, "c").select("doc_id", "start", F.regexp_replace("text", " +$", "").alias("value"), "pii_type")


for _r in BY_ID:
    _spans_query(_r)


@query("normalize_text", r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+', ''), '\s+\z', '')) as digest from documents""")  # fmt: skip
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize("text").cast("binary")).alias("digest"))


@query("text_stats", "select count(*) as n, sum(length(text))::bigint as characters, max(length(text))::bigint as longest, sum(len(string_split(text, chr(10))))::bigint as lines from documents")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("composite_union", f"select doc_id, pii_type, value, count(*) as n from (select doc_id, pii_type, rtrim(value, ' ') as value from ({ALL_FOUND}) union all select doc_id, pii_type, rtrim(value, ' ') from ({ALL_FOUND}) where pii_type = 'ip_address') group by all")
def composite_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    both = detect.composite(detect.regex_detect(d), detect.regex_detect(d, [BY_ID["ip_address"]]))
    return both.groupBy(F.col("document_id").alias("doc_id"), "pii_type", F.regexp_replace("text", " +$", "").alias("value")).agg(F.count("*").alias("n"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in the registry's shape: ``document_id, id, pii_type, start, doc_id``."""
    c = documents(spark, sf_dir).select("document_id", "doc_id", detect.rule_candidates("text").alias("c"))
    rows = detect.explode_candidates(c, "c")
    return rows.select("document_id", "doc_id", (F.col("doc_id") * 10000 + F.col("ord")).alias("id"), "pii_type", "start", "end")


@query("pii_per_document", f"with f as ({ALL_FOUND}) select d.doc_id, count(f.doc_id) as pii_count from documents d left join f on d.doc_id = f.doc_id group by d.doc_id")
def pii_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = registry.counts_per_document(documents(spark, sf_dir), instances(spark, sf_dir))
    return n.select(F.element_at(F.split("document_id", "/"), -1).cast("long").alias("doc_id"), "pii_count")


@query("docs_without_pii", f"select doc_id from documents where doc_id not in (select doc_id from ({ALL_FOUND}))")
def docs_without_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(instances(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")


@query("inventory_by_source_lang", f"select source, lang, pii_type, count(*) as n from ({ALL_FOUND}) group by rollup (source, lang, pii_type)")
def inventory_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_values(spark, sf_dir).rollup("source", "lang", "pii_type").agg(F.count("*").alias("n"))


def _text_pii(name: str, tab: str, keys: str, col: str) -> None:
    parts = " union all ".join(f"select {keys}, '{r.pii_type}' as pii_type, unnest({_found(r.rule_id, col)}) as v from {tab}" for r in config.DEFAULT_RULES)

    @query(name, f"select {keys}, pii_type, count(*) as n from ({parts}) group by all")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ks = keys.split(", ")
        c = table(spark, sf_dir, tab).select(*ks, detect.rule_candidates(col).alias("c"))
        return detect.explode_candidates(c, "c").groupBy(*ks, "pii_type").agg(F.count("*").alias("n"))


_text_pii("conversation_pii", "conversations", "conv_id, turn", "text")
_text_pii("page_pii", "pages", "page_id", "html")


@query("rule_catalog_join", f"select source, sum(case when special then 1 else 0 end)::bigint as special, count(*) as n from ({ALL_FOUND}) f join (values {', '.join(f"('{i}', {str(s).lower()})" for i, _, _, s in config.CATALOG)}) c(id, special) on f.pii_type = c.id group by source")
def rule_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.broadcast(config.catalog_frame(spark))
    f = found_values(spark, sf_dir).join(c, F.col("pii_type") == F.col("id"))
    return f.groupBy("source").agg(F.sum(F.col("special_category").cast("long")).alias("special"), F.count("*").alias("n"))


@query("annotated_parse", r"""
with t as (select doc_id, '{{person_name:' || lang || doc_id || '}} wrote {{address :' || chr(10) || source || '}} ' || text as s from documents),
p as (select doc_id, regexp_extract_all(s, '(?s)\{\{(.*?):(.*?)\}\}', 1) as k, regexp_extract_all(s, '(?s)\{\{(.*?):(.*?)\}\}', 2) as v, regexp_split_to_array(s, '(?s)\{\{(.*?):(.*?)\}\}') as g,
  regexp_replace(s, '(?s)\{\{(.*?):(.*?)\}\}', '\2', 'g') as clean from t)
select doc_id, clean, trim(k[i + 1]) as pii_type,
  (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i], lambda x: length(x))), 0))::int as start, v[i + 1] as value
from (select *, unnest(range(len(k))) as i from p)""")  # fmt: skip
def annotated_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(tx.annotate(F.lit("person_name"), F.concat("lang", "doc_id")), F.lit(" wrote "), F.lit("{{address :\n"), "source", F.lit("}} "), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.annotated(marked).alias("a")).select("doc_id", F.col("a.text").alias("clean"), F.explode("a.spans").alias("s"))
    return rows.select("doc_id", "clean", "s.pii_type", "s.start", F.expr("substring(clean, s.start + 1, s.end - s.start)").alias("value"))


@query("sliding_windows", """
select doc_id, k::int as chunk_no, (k * 1800)::int as "offset", md5(substr(text, (k * 1800 + 1)::int, 2000)) as digest
from (select doc_id, text, unnest(range(greatest(0, ceil((length(text) - 2000) / 1800.0))::bigint + 1)) as k from documents where length(text) > 0)""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = detect.windows(documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text"))
    return w.select(F.col("document_id").alias("doc_id"), "chunk_no", "offset", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("locate_occurrences", "select doc_id, i::int as k from (select doc_id, text, unnest(range(length(text) - 3)) as i from documents where length(text) >= 4) where substr(text, (i + 1)::int, 4) = 'then'")
def locate_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.occurrences("text", F.lit("then"))).alias("k"))


@query("ai_locate")
def ai_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-model path with a scripted backend that quotes the words after 'the'."""

    def backend():
        import json
        import re

        return lambda p: "found: " + json.dumps([{"value": v, "pii_type": "person_name", "rationale": None} for v in sorted(set(re.findall(r"\bthe ([a-z]{9,})", p.partition("Text:\n")[2])))]) + " end"

    return detect.llm_detect(documents(spark, sf_dir).select("document_id", "text"), backend).select("document_id", "ord", "start", "end", "text", "pii_type", "confidence")


@query("ai_sample")
def ai_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ai_sample(documents(spark, sf_dir).select("document_id"), 10)


def _placed_sql(pattern: str, rank: int, pii_type: str, confidence: float) -> str:
    """``document_id, r, k, start, value, pii_type, confidence`` of a pattern, offsets by the lengths of gaps and matches."""
    return f"""
    select document_id, {rank} as r, i as k, (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::int as start, m[i + 1] as value, '{pii_type}' as pii_type, {confidence}::double as confidence
    from (select document_id, unnest(range(len(m))) as i, m, g from (select {DOC_ID} as document_id, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as g from documents))"""


_SHARED_SQL = [_placed_sql(_pattern(r.rule_id), i, r.pii_type, r.base_confidence) for i, r in enumerate(SHARED)]
_WORDS = {"PERSON": ("Thea", "Anand"), "LOCATION": ("Chen", "Erst")}
_IN_ORDER = "(row_number() over (partition by document_id order by r, k) - 1)::int as ord"


@query("engine_gazetteer")  # without SQL: at letters outside of ASCII its word boundaries are others
def engine_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id", "text")
    engine = detect.gazetteer(_WORDS)
    return jobs.scan_documents(d, SHARED, engine).select("document_id", "ord", "start", "end", "pii_type", "confidence", "level")


# --- fusion and scoring: the rules against a second, looser set that stands in for ner ----

_LOOSE = (config.Rule("loose_number", "credit_card", r"\d[\d -]{6,}\d", 0.4), config.Rule("loose_dotted", "ip_address", r"\d+(?:\.\d+){2,}", 0.45), config.Rule("loose_host", "ip_address", r"@[\w.]+", 0.3))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with the strict candidates ``r``, the loose ones ``n`` and a third source ``a``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.transform(detect.rule_candidates("text", _LOOSE), lambda c: c.withField("detector_kind", F.lit("ner")).withField("detector_id", F.lit("presidio.ner")))
    a = F.transform(detect.rule_candidates("text", (BY_ID["email"], _ANY_NUMBER)), lambda c: c.withField("detector_kind", F.lit("ai")).withField("detector_id", F.lit("ai.llm")))
    return d.select("doc_id", detect.rule_candidates("text").alias("r"), n.alias("n"), a.alias("a"))


def _side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return detect.explode_candidates(_sides(spark, sf_dir).select(F.col("doc_id").alias("document_id"), name), name)


def _rows_sql(rs: tuple[config.Rule, ...], cte: str) -> str:
    """CTE of spans of several rules: doc_id, rule_no, k, s, e, pii_type."""
    one = lambda i, r: f"""select doc_id, {i} as rule_no, i as k, (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::int as s, length(m[i + 1]) as n, '{r.pii_type}' as pii_type
      from (select doc_id, unnest(range(len(m))) as i, m, g from (select doc_id, regexp_extract_all(text, '{r.pattern}') as m, regexp_split_to_array(text, '{r.pattern}') as g from documents))"""  # noqa: E731
    return f"{cte} as (select doc_id, s, (s + n)::int as e, pii_type from ({' union all '.join(one(i, r) for i, r in enumerate(rs))}))"


_STRICT_IP, _LOOSE_IP = (BY_ID["ip_address"], BY_ID["italian_id"]), _LOOSE[1:]
_PAIRS = f"with {_rows_sql(_STRICT_IP, 'a')}, {_rows_sql(_LOOSE_IP, 'b')}"
_IOU = "(least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s))::double"


def _ip_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return detect.regex_detect(d, _STRICT_IP), detect.regex_detect(d, _LOOSE_IP)


@query("overlap_pairs", f"{_PAIRS} select a.doc_id, a.s as a_start, a.e as a_end, b.s as b_start, b.e as b_end from a join b on a.doc_id = b.doc_id and a.s < b.e and b.s < a.e")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fuse.overlap_pairs(*_ip_sides(spark, sf_dir))
    return p.select(F.col("document_id").alias("doc_id"), F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))


@query("iou_pairs", f"{_PAIRS} select a.doc_id, a.s as a_start, b.s as b_start, round({_IOU}, 6) as iou from a join b on a.doc_id = b.doc_id and a.s < b.e and b.s < a.e where {_IOU} >= 0.5")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fuse.overlap_pairs(*_ip_sides(spark, sf_dir), ratio=0.5)
    return p.select(F.col("document_id").alias("doc_id"), F.col("a.start").alias("a_start"), F.col("b.start").alias("b_start"), F.round("iou", 6).alias("iou"))


def _cands_sql(rs: tuple[config.Rule, ...], cte: str, detector: str | None = None) -> str:
    """CTE of the candidates of several rules, in order, as one list a document."""
    one = lambda k, r: f"""select doc_id, {k} as rule_no, i, (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::int as s, length(m[i + 1])::int as n, length(rtrim(m[i + 1], ' '))::int as seen,
      '{r.pii_type}' as t, {r.base_confidence}::double as c, '{detector or f"regex.{r.rule_id}"}' as d
      from (select doc_id, unnest(range(len(m))) as i, m, g from (select doc_id, regexp_extract_all(text, '{EMAIL_SQL if r.rule_id == "email" else r.pattern}') as m, regexp_split_to_array(text, '{EMAIL_SQL if r.rule_id == "email" else r.pattern}') as g from documents))"""  # noqa: E731
    return f"""{cte} as (select doc_id, list({{'s': s, 'e': s + n, 't': t, 'c': c, 'd': d, 'v': s + seen}} order by rule_no, i) as l from ({' union all '.join(one(k, r) for k, r in enumerate(rs))}) group by doc_id)"""


#: A card may end in a blank before a letter beyond ASCII, where other dialects see no word boundary: ends are told without it.
_VISIBLE_END = "m.start + length(rtrim(m.text)) as end"
_ANY_NUMBER = config.Rule("any_number", "phone", r"\d{3,}[\d .-]*\d", 0.6)
_NO_CANDIDATE = "[]::struct(s int, e int, t varchar, c double, d varchar, v int)[]"


def _best_sql(x: str, among: str, free: str = "true") -> str:
    """The place, from 0, of the span of a list that overlaps most with ``x``; null where none does by half."""
    y = f"{among}[k + 1]"
    iou = f"case when least({x}.e, {y}.e) > greatest({x}.s, {y}.s) then (least({x}.e, {y}.e) - greatest({x}.s, {y}.s)) / (greatest({x}.e, {y}.e) - least({x}.s, {y}.s))::double else 0 end"
    return f"(list_sort(list_filter(list_transform(range(len({among})), lambda k: {{'v': -({iou}), 'k': k::int}}), lambda z: z.v <= -0.5 and {free})))[1].k"


#: One step a pattern candidate: its best free partner is taken.
_FUSED = f"""with recursive {_cands_sql(config.DEFAULT_RULES, 'rc')}, {_cands_sql(_LOOSE, 'nc', 'presidio.ner')}, {_cands_sql((BY_ID['email'], _ANY_NUMBER), 'ac', 'ai.llm')},
j as (select d.doc_id, coalesce(rc.l, {_NO_CANDIDATE}) as r, coalesce(nc.l, {_NO_CANDIDATE}) as n, coalesce(ac.l, {_NO_CANDIDATE}) as a from documents d left join rc using (doc_id) left join nc using (doc_id) left join ac using (doc_id) where rc.l is not null or nc.l is not null or ac.l is not null),
st as (select doc_id, r, n, 0 as i, []::int[] as used, []::int[] as p from j
  union all select doc_id, r, n, i + 1, case when b is null then used else list_append(used, b) end, list_append(p, b) from (select *, {_best_sql('r[i + 1]', 'n', 'not list_contains(used, z.k)')} as b from st where i < len(r))),
parts as (select doc_id, r[i + 1] as x, n[p[i + 1] + 1] as y, i, used, n from (select *, unnest(range(len(r))) as i from (select * exclude (i) from st where i = len(r)))),
one as (
  select doc_id, 0 as part, i, 0 as sub, x as z, least(1.0, greatest(x.c, y.c) + 0.15) as conf, 'double_confirmed' as level, [x.d, y.d] as src from parts where x.t = y.t
  union all select doc_id, 0, i, 0, x, x.c, case when y is null then 'single_source' else 'conflicting' end, [x.d] from parts where y is null or x.t <> y.t
  union all select doc_id, 0, i, 1, y, y.c, 'conflicting', [y.d] from parts where x.t <> y.t
  union all select doc_id, 1, i, 0, n[i + 1], n[i + 1].c, 'single_source', [n[i + 1].d] from (select doc_id, n, used, unnest(range(len(n))) as i from st where i = len(r)) where not list_contains(used, i)),
fused as (select doc_id, (row_number() over (partition by doc_id order by part, i, sub) - 1)::int as ord, z.s as s, z.e as e, z.v as v, z.t as t, conf, level, src from one)"""
_MATCH_COLUMNS = 'doc_id, ord, s as "start", v as "end", t as pii_type, round(conf, 6) as confidence, level, array_to_string(src, \'+\') as sources'

#: One step a language-model candidate, over the list of what was there before and what came to it.
_ABSORBED = f"""{_FUSED},
fl as (select doc_id, list({{'s': s, 'e': e, 'v': v, 't': t, 'c': conf, 'l': level, 'src': src}} order by ord) as m from fused group by doc_id),
sa as (select j.doc_id, j.a, coalesce(fl.m, []) as m, len(coalesce(fl.m, [])) as old, 0 as i from j left join fl using (doc_id)
  union all select doc_id, a, case
      when b is null then list_append(m, {{'s': x.s, 'e': x.e, 'v': x.v, 't': x.t, 'c': x.c, 'l': 'ai_discovered', 'src': [x.d]}})
      when m[b + 1].t <> x.t then list_append(list_transform(range(len(m)), lambda k: case when k = b then {{'s': m[k + 1].s, 'e': m[k + 1].e, 'v': m[k + 1].v, 't': m[k + 1].t, 'c': m[k + 1].c, 'l': case when m[k + 1].l = 'single_source' then 'conflicting' else m[k + 1].l end, 'src': m[k + 1].src}} else m[k + 1] end), {{'s': x.s, 'e': x.e, 'v': x.v, 't': x.t, 'c': x.c, 'l': 'conflicting', 'src': [x.d]}})
      when list_contains(m[b + 1].src, x.d) then m
      else list_transform(range(len(m)), lambda k: case when k = b then {{'s': m[k + 1].s, 'e': m[k + 1].e, 'v': m[k + 1].v, 't': m[k + 1].t, 'c': least(1.0, m[k + 1].c + 0.15), 'l': case when m[k + 1].l = 'single_source' then 'double_confirmed' else m[k + 1].l end, 'src': list_append(m[k + 1].src, x.d)}} else m[k + 1] end) end, old, i + 1
    from (select *, a[i + 1] as x, {_best_sql('a[i + 1]', 'm[1:old]')} as b from sa where i < len(a))),
absorbed as (select doc_id, k::int as ord, m[k + 1].s as s, m[k + 1].e as e, m[k + 1].v as v, m[k + 1].t as t, m[k + 1].c as conf, m[k + 1].l as level, m[k + 1].src as src from (select doc_id, m, unnest(range(len(m))) as k from sa where i = len(a)))"""


@query("fusion_matches", f"{_FUSED} select {_MATCH_COLUMNS} from fused")
def fusion_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sides(spark, sf_dir).select("doc_id", F.posexplode(fuse.fuse(F.col("r"), F.col("n"))).alias("ord", "m"))
    return m.select("doc_id", "ord", "m.start", F.expr(_VISIBLE_END), "m.pii_type", F.round("m.confidence", 6).alias("confidence"), "m.level", F.array_join("m.sources.detector_id", "+").alias("sources"))


@query("fusion_levels", f"{_FUSED} select level, t as pii_type, count(*) as n from fused group by all")
def fusion_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sides(spark, sf_dir).select(F.explode(fuse.fuse(F.col("r"), F.col("n"))).alias("m"))
    return m.groupBy("m.level", "m.pii_type").agg(F.count("*").alias("n"))


@query("ai_absorb", f"{_ABSORBED} select {_MATCH_COLUMNS} from absorbed")
def ai_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sides(spark, sf_dir).select("doc_id", F.posexplode(fuse.fuse(F.col("r"), F.col("n"), F.col("a"))).alias("ord", "m"))
    return m.select("doc_id", "ord", "m.start", F.expr(_VISIBLE_END), "m.pii_type", F.round("m.confidence", 6).alias("confidence"), "m.level", F.array_join("m.sources.detector_id", "+").alias("sources"))


#: One step a pair, best overlap first, ties to the highest places: it counts if both its spans are free.
_SPAN_COUNTS = f"""with recursive {_cands_sql(config.DEFAULT_RULES, 'rc')}, {_cands_sql(_LOOSE, 'nc', 'presidio.ner')},
ds as (select doc_id, unnest(range(len(l))) as i, unnest(l) as x from nc), gs as (select doc_id, unnest(range(len(l))) as j, unnest(l) as y from rc),
near as (select doc_id, i, j, (least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double as v from ds join gs using (doc_id) where x.t = y.t and x.s < y.e and y.s < x.e),
ranked as (select doc_id, i, j, row_number() over (partition by doc_id order by v desc, i desc, j desc) as no from near where v >= 0.5),
taken as (select distinct doc_id, 1::bigint as no, []::bigint[] as ui, []::bigint[] as uj from ranked
  union all select t.doc_id, t.no + 1, case when list_contains(ui, i) or list_contains(uj, j) then ui else list_append(ui, i) end, case when list_contains(ui, i) or list_contains(uj, j) then uj else list_append(uj, j) end from taken t join ranked r on r.doc_id = t.doc_id and r.no = t.no),
used as (select doc_id, arg_max(ui, no) as ui, arg_max(uj, no) as uj from taken group by doc_id),
c as (select x.t as pii_type, coalesce(list_contains(ui, i), false)::int as tp, (not coalesce(list_contains(ui, i), false))::int as fp, 0 as fn from ds left join used using (doc_id)
  union all select y.t, 0, 0, (not coalesce(list_contains(uj, j), false))::int from gs left join used using (doc_id))"""
_PRF = """select pii_type, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0::double end, 6) as f1 from (
  select coalesce(pii_type, 'OVERALL') as pii_type, tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp)::double else 0.0::double end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0.0::double end as r
  from (select pii_type, coalesce(sum(tp), 0)::bigint as tp, coalesce(sum(fp), 0)::bigint as fp, coalesce(sum(fn), 0)::bigint as fn from c group by rollup (pii_type)))"""


@query("span_score", f"{_SPAN_COUNTS} {_PRF}")
def span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = score.span_counts(_side(spark, sf_dir, "n"), _side(spark, sf_dir, "r"))
    return score.report(c).select("pii_type", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


_VALUES = "d as (select doc_id, 'ip_address' as pii_type, lower(unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+){2,}'))) as v from documents), g as (select doc_id, 'ip_address' as pii_type, lower(unnest(" + _found("ip_address") + ")) as v from documents)"
_VALUE_COUNTS = f"with {_VALUES}, x as (select doc_id, pii_type, v, count(*) as n from d group by all), y as (select doc_id, pii_type, v, count(*) as n from g group by all), c as (select coalesce(x.pii_type, y.pii_type) as pii_type, least(coalesce(x.n, 0), coalesce(y.n, 0)) as tp, coalesce(x.n, 0) - least(coalesce(x.n, 0), coalesce(y.n, 0)) as fp, coalesce(y.n, 0) - least(coalesce(x.n, 0), coalesce(y.n, 0)) as fn from x full join y on x.doc_id = y.doc_id and x.v = y.v)"


def _value_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    val = lambda r: detect.regex_detect(d, [r]).select("document_id", "pii_type", F.col("text").alias("value"))
    return val(_LOOSE[1]), val(BY_ID["ip_address"])


@query("value_score", f"{_VALUE_COUNTS} {_PRF}")
def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.report(score.value_counts(*_value_sides(spark, sf_dir))).select("pii_type", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("type_count_score", f"with {_VALUES}, x as (select doc_id, count(*) as n from d where doc_id in (select doc_id from g) group by all), y as (select doc_id, count(*) as n from g group by all), c as (select 'ip_address' as pii_type, least(coalesce(x.n, 0), y.n) as tp, coalesce(x.n, 0) - least(coalesce(x.n, 0), y.n) as fp, y.n - least(coalesce(x.n, 0), y.n) as fn from y left join x using (doc_id)) {_PRF}")
def type_count_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.report(score.type_counts(*_value_sides(spark, sf_dir))).select("pii_type", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("prf_rollup", "with c as (select case when quality = 1 then 'good' else 'bad' end as pii_type, (toxic = 0)::int as tp, (toxic = 1)::int as fp, (quality = 0)::int as fn from labels) " + _PRF)
def prf_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("pii_type"), (F.col("toxic") == 0).cast("int").alias("tp"), (F.col("toxic") == 1).cast("int").alias("fp"), (F.col("quality") == 0).cast("int").alias("fn"))
    return score.report(c).select("pii_type", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("sample_draw")
def sample_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.sample_documents(table(spark, sf_dir, "documents").select("doc_id"), 20, key="doc_id")


# --- checksums --------------------------------------------------------------------------

_DIGITS = "list_transform(range(length(d)), lambda i: substr(d, (i + 1)::int, 1)::int)"
_LUHN = "list_sum(list_transform(range(length(d)), lambda i: case when (length(d) - i) % 2 = 0 then case when substr(d, (i + 1)::int, 1)::int > 4 then substr(d, (i + 1)::int, 1)::int * 2 - 9 else substr(d, (i + 1)::int, 1)::int * 2 end else substr(d, (i + 1)::int, 1)::int end)) % 10 = 0"


@query("luhn_valid_cards", f"select doc_id, d as digits, {_LUHN} as valid from (select doc_id, regexp_replace(v, '\\D', '', 'g') as d from (select doc_id, unnest({_found('credit_card')}) as v from documents))")
def luhn_valid_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found_values(spark, sf_dir).where("pii_type = 'credit_card'")
    return f.select("doc_id", F.regexp_replace("value", r"\D", "").alias("digits"), checks.luhn("value").alias("valid"))


@query("iban_mod97", """
with t as (select o_orderkey, 'CH' || lpad((o_orderkey % 100)::varchar, 2, '0') || lpad(o_custkey::varchar, 12, '0') || 'A0007' as iban from orders),
n as (select o_orderkey, iban, substr(iban, 5) || substr(iban, 1, 4) as r from t)
select o_orderkey, iban, list_reduce(list_prepend(0, list_transform(range(length(r)), lambda i: case when ascii(substr(r, (i + 1)::int, 1)) >= 65 then 1000 + ascii(substr(r, (i + 1)::int, 1)) - 55 else ascii(substr(r, (i + 1)::int, 1)) - 48 end)),
  lambda a, x: case when x >= 1000 then (a * 100 + x - 1000) % 97 else (a * 10 + x) % 97 end)::int as remainder from n""")  # fmt: skip
def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    iban = F.concat(F.lit("CH"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit("A0007"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iban.alias("iban")).withColumn("remainder", checks.mod97("iban"))


@query("ean13_check", "select c_custkey, ((10 - list_sum(list_transform(range(12), lambda i: substr(d, (i + 1)::int, 1)::int * case when i % 2 = 1 then 3 else 1 end)) % 10) % 10)::int as digit from (select c_custkey, '756' || lpad((c_custkey * 7919 % 1000000000)::varchar, 9, '0') as d from customer)")
def ean13_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    twelve = F.concat(F.lit("756"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", checks.ean13_digit(twelve).alias("digit"))


# --- folder rules -----------------------------------------------------------------------

RULES = (("", ["records"]), ("src1", ["payroll", "hiring"]), ("src1/en", ["contracts", "payroll"]), ("src2/", ["legal"]), ("src3/de", ["ghost"]))
_RULES_SQL = "(values ('', ['records']), ('src1', ['payroll', 'hiring']), ('src1/en', ['contracts', 'payroll']), ('src2', ['legal']), ('src3/de', ['ghost'])) r(prefix, ids)"
_MATCH_SQL = f"select d.doc_id, r.prefix, r.ids from documents d, {_RULES_SQL} where r.prefix = '' or {DOC_ID} = r.prefix or starts_with({DOC_ID}, r.prefix || '/')"


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "prefix string, activity_ids array<string>")


def _with_doc(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.element_at(F.split("document_id", "/"), -1).cast("long")).drop("document_id")


@query("folder_rule_match", f"select doc_id, prefix from ({_MATCH_SQL})")
def folder_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_doc(rules.matches(documents(spark, sf_dir), rules_frame(spark))).select("doc_id", "prefix")


_INHERITED_SQL = f"""select doc_id, list(id order by p, k) as ids from (
  select doc_id, id, min(p) as p, arg_min(k, p) as k from (select doc_id, prefix as p, unnest(ids) as id, unnest(range(len(ids))) as k from ({_MATCH_SQL})) group by doc_id, id) group by doc_id"""


@query("inherited_activities", f"select doc_id, array_to_string(ids, ',') as ids from ({_INHERITED_SQL})")
def inherited_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_doc(rules.inherited(documents(spark, sf_dir), rules_frame(spark))).select("doc_id", F.array_join("activity_ids", ",").alias("ids"))


@query("rule_document_counts", f"select r.prefix, count(m.doc_id) as documents from {_RULES_SQL} left join ({_MATCH_SQL}) m on m.prefix = r.prefix group by r.prefix")
def rule_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_counts(documents(spark, sf_dir), rules_frame(spark))


@query("reconcile_counts", f"""
with m as (select distinct doc_id from documents d, {_RULES_SQL} where r.prefix <> '' and ({DOC_ID} = r.prefix or starts_with({DOC_ID}, r.prefix || '/'))),
s as (select d.doc_id, case doc_id % 3 when 0 then 'manual' when 1 then 'rule' end as src, m.doc_id is not null as hit from documents d left join m using (doc_id))
select count(*) filter (src is distinct from 'manual' and hit) as associated, count(*) filter (src = 'manual') as skipped_manual, count(*) filter (src = 'rule' and not hit) as cleared, count(*) filter (src is null and not hit) as unmatched from s""")  # fmt: skip
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "manual").when(F.col("doc_id") % 3 == 1, "rule")
    d = documents(spark, sf_dir).select("document_id", F.array(F.lit("old")).alias("activity_ids"), source.alias("association_source"))
    return rules.outcome_counts(rules.reconcile(d, rules_frame(spark).where("prefix <> ''")))


@query("activity_names", f"select prefix, array_to_string(list(coalesce(n.name, i.id) order by i.k), ',') as names from (select prefix, unnest(ids) as id, unnest(range(len(ids))) as k from {_RULES_SQL}) i left join (values ('payroll', 'Payroll'), ('records', 'Records'), ('legal', 'Legal affairs'), ('contracts', 'Contracts'), ('hiring', 'Hiring')) n(id, name) on i.id = n.id group by prefix")
def activity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules_frame(spark).withColumn("prefix", rules.normal_prefix(F.col("prefix")))
    return rules.activity_names(r, activities(spark)).select("prefix", F.array_join("names", ",").alias("names"))


# --- register ---------------------------------------------------------------------------

ACTIVITIES = (("payroll", "Payroll"), ("records", "Records"), ("legal", "Legal affairs"), ("contracts", "Contracts"), ("hiring", "Hiring"))
MACROS = ((1, "payroll", "Economic information", "5 years", 60), (2, "records", "Contact", "2 anni", 24), (3, "legal", "Identity", "on request", None), (4, "contracts", "Technical", "6 mois", 6), (5, "hiring", "Identity", "1 year", 12))
CATEGORIES = ((11, 1, "cards", ["credit_card", "iban"], "confirmed"), (12, 1, "odd wording", [], "confirmed"), (21, 2, "email", ["email"], "confirmed"), (31, 3, "e-mail", ["email", "phone"], "confirmed"), (41, 4, "ip", ["ip_address"], "confirmed"), (42, 4, "phone", ["phone"], "proposed"), (51, 5, "names", ["person_name", "ip_address"], "proposed"), (52, 5, "photo", [], "confirmed"))


def _lit(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, list):
        return "[" + ", ".join(map(_lit, x)) + "]::varchar[]"
    return str(x) if isinstance(x, int) else "'" + x + "'"


def _values(rows, name: str, columns: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) {name}({columns})"


_MACROS_SQL = _values(MACROS, "m", "mid, aid, mtext, rtext, months")
_CATS_SQL = _values(CATEGORIES, "c", "cid, mid, ctext, types, state")


def activities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, "") for i, n in ACTIVITIES], "id string, name string, purpose string")


def macros(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m, k) for k, m in enumerate(MACROS)], schemas.MACRO)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, [k]) for k, c in enumerate(CATEGORIES)], schemas.CATEGORY)


_RETENTION_TEXTS = ("5 years from the payment", "2 anni", "6 months", "24 mesi", "1 year", "5 ans a compter", "1 an", "6 mois", "2 anni e 6 mesi", "a criterio", "N/A", "", "1 annata", "12MONTHS", "10  Years")


@query("parse_retention", f"select t, case when n <> '' then n::int * case when lower(u) in ('month','months','mese','mesi','mois') then 1 else 12 end end as months from (select t, regexp_extract(t, '(?i)(\\d+)\\s*(months|years|month|years|year|anno|anni|mese|mesi|mois|ans|an)\\b', 1) as n, regexp_extract(t, '(?i)(\\d+)\\s*(months|years|month|year|anno|anni|mese|mesi|mois|ans|an)\\b', 2) as u from (values {', '.join(f"('{x}')" for x in _RETENTION_TEXTS)}) v(t))")
def parse_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in _RETENTION_TEXTS], "t string").select("t", phrases.retention_months("t").alias("months"))


_CATEGORY_TEXTS = ("Last names, names and addresses", "Bank account details", "nome, cognome e indirizzo di residenza", "indirizzo email e numero di telefono", "estremi della carta di credito", "dati sanitari e diagnosi mediche", "indirizzo IP del dispositivo", "recapito email aziendale", "numero di cellulare personale", "luogo e data di nascita", "fotografia del dipendente", "partita IVA", "e-mail; pec / telefono", "dati anagrafici & contatti", "")


@query("split_categories", f"select t, trim(p) as part from (select t, unnest(regexp_split_to_array(t, '(?i)[;,/&]|\\b(?:e|ed|and)\\b')) as p from (values {', '.join(f"('{x}')" for x in _CATEGORY_TEXTS)}) v(t)) where trim(p) <> ''")
def split_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in _CATEGORY_TEXTS], "t string").select("t", F.explode(phrases.split_categories("t")).alias("part"))


_SPLIT_SQL = r"list_filter(list_transform(regexp_split_to_array(t, '(?i)[;,/&]|\b(?:e|ed|and)\b'), lambda x: trim(x)), lambda x: x <> '')"
_PHRASES_SQL = ", ".join(f"({i}, {_lit(p)}, {_lit(types)}, {len(p.split())})" for i, (p, types, _) in enumerate(sorted(config.phrase_table(), key=lambda r: -len(r[0].split()))))


def _mapped_sql(texts: str) -> str:
    """CTEs from ``texts(t)`` to ``mapped(t, n, k, part, types)``: one step a phrase, the longest first."""
    return f"""with recursive ph(no, p, types, words) as (values {_PHRASES_SQL}), texts(t) as ({texts}),
parts as (select t, len(ps) as n, unnest(range(len(ps)))::int as k, unnest(ps) as part from (select t, {_SPLIT_SQL} as ps from texts)),
st as (select t, n, k, part, ' ' || lower(regexp_replace(part, '\\s+', ' ', 'g')) || ' ' as l, []::varchar[] as o, 0 as no from parts
  union all select t, n, k, part, case when spot > 0 then substr(l, 1, spot - 1) || ' ' || repeat('# ', words) || substr(l, spot + length(p) + 2) else l end, case when spot > 0 then list_concat(o, types) else o end, no + 1
    from (select st.*, ph.p, ph.types, ph.words, instr(l, ' ' || ph.p || ' ') as spot from st join ph on ph.no = st.no)),
mapped as (select t, n, k, part, coalesce(array_to_string(coalesce(e.types, list_filter(o, lambda x, i: list_position(o, x) = i)), ','), '') as types
  from st left join ph e on e.p = lower(regexp_replace(part, '\\s+', ' ', 'g')) where st.no = {len(config.phrase_table())})"""


@query("map_dictionary", _mapped_sql(f"values {', '.join(f'({_lit(x)})' for x in _CATEGORY_TEXTS)}") + " select t, k, part as text, types from mapped")
def map_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in _CATEGORY_TEXTS], "t string").select("t", F.posexplode(phrases.map_categories("t")).alias("k", "x"))
    return rows.select("t", "k", "x.text", F.array_join("x.pii_types", ",").alias("types"))


_GRID = ((("Name of the processing operation", "Payroll  Management"), ("Main purpose", "Pay"), ("x",), ("Categories of personal data", "d", "r"), ("Identity", "names", "5 years"), ("Money", "iban, nome", "2 anni"), ("",), ("Other", "z", "1 year")), (("Tutorial",), ("Categories of personal data",), ("A", "b", "")))


def grid_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{i}", k, list(r)) for i, g in enumerate(_GRID) for k, r in enumerate(g)], "sheet string, row_no int, cells array<string>")


_SECTION_SQL = """
with g(sheet, row_no, c0, c1, c2) as (values """ + ", ".join(f"('s{i}', {k}, '{r[0]}', '{r[1] if len(r) > 1 else ''}', '{r[2] if len(r) > 2 else ''}')" for i, g in enumerate(_GRID) for k, r in enumerate(g)) + """),
h as (select sheet, min(row_no) as h from g where c0 = 'Categories of personal data' group by sheet),
n as (select sheet, arg_min(c1, row_no) as name from g where c0 = 'Name of the processing operation' group by sheet),
a as (select g.*, min(case when c0 = '' then row_no end) over (partition by g.sheet) as stop from g join h using (sheet) where row_no > h)
select regexp_replace(lower(trim(n.name)), '\\s+', '-', 'g') as activity_id, c0 as raw_text, c1 as category_text, c2 as retention_text from a join n using (sheet) where n.name <> '' and (stop is null or row_no < stop)"""  # fmt: skip


@query("register_section", _SECTION_SQL)
def register_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = register.ingest(grid_frame(spark))
    return register.flat(r["activities"], r["macros"], r["categories"]).select("activity_id", F.col("macro_text").alias("raw_text"), "category_text", "retention_text")


@query("register_map_pass", _mapped_sql(f"select category_text from ({_SECTION_SQL})") + " select case when n = 1 and types = '' then t else part end as raw_text, types, 'proposed' as mapping_state from mapped")
def register_map_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = register.ingest(grid_frame(spark))
    return register.map_pass(r["categories"]).select("raw_text", F.array_join("pii_types", ",").alias("types"), "mapping_state")


@query("shortest_retention", f"select aid as activity_id, min(months) as retention_months from {_MACROS_SQL} group by aid")
def shortest_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.shortest_retention(macros(spark))


@query("declared_types", f"select aid as activity_id, array_to_string(list(distinct t order by t), ',') as declared from (select m.aid, unnest(c.types) as t from {_CATS_SQL} join {_MACROS_SQL} using (mid) where state = 'confirmed') group by aid")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comply.declared_types(macros(spark), categories(spark)).where("size(declared) > 0").select("activity_id", F.array_join("declared", ",").alias("declared"))


# --- verdicts ---------------------------------------------------------------------------

NOW = "2026-01-01 00:00:00"
_DATE_SQL = "(timestamp '2026-01-01 00:00:00' - to_days((doc_id * 37 % 4000)::int))"


def associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the activities that their folders give and a date from doc_id."""
    d = documents(spark, sf_dir).select("document_id", "doc_id")
    ids = rules.inherited(d, rules_frame(spark))
    date = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - (F.col("doc_id") * 37 % 4000) * 86400)
    return d.join(ids, "document_id").select("document_id", "doc_id", "activity_ids", date.alias("reference_date"))


def _register(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return macros(spark), categories(spark)


def now(spark: SparkSession | None = None):
    return F.lit(NOW).cast("timestamp")


_VERDICT_CTE = f"""with inh as ({_INHERITED_SQL}), asc_ as (select doc_id, unnest(ids) as aid, unnest(range(len(ids))) as pos from inh),
live as (select c.cid, c.mid, c.ctext, c.types, m.aid, m.mtext, m.months from {_CATS_SQL} join {_MACROS_SQL} using (mid) where state = 'confirmed'),
dt as (select doc_id, list(distinct pii_type order by pii_type) as det from ({ALL_FOUND}) group by doc_id),
dc as (select doc_id, list(distinct t order by t) as dec from (select a.doc_id, unnest(l.types) as t from asc_ a join live l on a.aid = l.aid) group by doc_id),
s as (select i.doc_id, coalesce(dt.det, []::varchar[]) as det, coalesce(dc.dec, []::varchar[]) as dec from inh i left join dt using (doc_id) left join dc using (doc_id))"""


@query("orphan_covered_missing", _VERDICT_CTE + " select doc_id, array_to_string(list_filter(det, lambda x: not list_contains(dec, x)), ',') as orphan, array_to_string(list_filter(det, lambda x: list_contains(dec, x)), ',') as covered, array_to_string(list_filter(dec, lambda x: not list_contains(det, x)), ',') as missing from s")
def orphan_covered_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = comply.type_sets(associated(spark, sf_dir), instances(spark, sf_dir), *_register(spark))
    return _with_doc(t).select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("orphan", "covered", "missing")])


@query("unresolved", _VERDICT_CTE + " select doc_id, array_to_string(list(ctext order by pos, mid, cid), ',') as unresolved from asc_ join live using (aid) where len(types) = 0 group by doc_id")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_doc(comply.unresolved(associated(spark, sf_dir), *_register(spark))).select("doc_id", F.array_join("unresolved", ",").alias("unresolved"))


@query("unknown_activities", _VERDICT_CTE + " select doc_id, array_to_string(list(aid order by pos), ',') as unknown from asc_ where aid not in ('payroll','records','legal','contracts','hiring') group by doc_id")
def unknown_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_doc(comply.unknown_activities(associated(spark, sf_dir), activities(spark))).select("doc_id", F.array_join("unknown_activity_ids", ",").alias("unknown"))


@query("coverage_first", _VERDICT_CTE + f", f as (select a.doc_id, t, arg_min(a.aid, a.pos) as aid from asc_ a join (select aid, unnest(types) as t from live) l on a.aid = l.aid group by a.doc_id, t) select d.pii_type, f.aid as activity_id, count(*) as n from ({ALL_FOUND}) d join inh using (doc_id) left join f on f.doc_id = d.doc_id and f.t = d.pii_type group by all")
def coverage_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = instances(spark, sf_dir)
    c = comply.coverage(associated(spark, sf_dir), own, *_register(spark))
    return c.join(own.select("id", "pii_type"), "id").groupBy("pii_type", "activity_id").agg(F.count("*").alias("n"))


_HELD = _VERDICT_CTE + f""", h as (select a.doc_id, a.pos, a.aid, l.mid, l.mtext, l.months, list(distinct t order by t) as types, greatest(0, floor((date_diff('second', {_DATE_SQL.replace('doc_id', 'a.doc_id')}, timestamp '{NOW}') // 86400) / 30.44))::int as age
  from asc_ a join (select aid, mid, mtext, months, unnest(types) as t from live) l on a.aid = l.aid join dt on dt.doc_id = a.doc_id and list_contains(dt.det, l.t) group by all)"""


@query("retention_flags", _HELD + " select doc_id, aid as activity_id, mtext as category, months as retention_months, age as age_months, age - months as overdue_months, array_to_string(types, ',') as pii_types from h where age > months")
def retention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = comply.retention(associated(spark, sf_dir), instances(spark, sf_dir), *_register(spark), now())
    return _with_doc(r.where("flag")).select("doc_id", "activity_id", "category", "retention_months", "age_months", "overdue_months", F.array_join("pii_types", ",").alias("pii_types"))


@query("retention_unverifiable", _HELD + " select doc_id, aid as activity_id, mtext as category from h where months is null")
def retention_unverifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = comply.retention(associated(spark, sf_dir), instances(spark, sf_dir), *_register(spark), now())
    return _with_doc(r.where("unverifiable")).select("doc_id", "activity_id", "category")


@query("retention_overview", _HELD + " select doc_id, count(*) filter (age > months)::int as n_flags, coalesce(max(case when age > months then age - months end), 0)::int as worst_overdue_months, count(*) filter (months is null)::int as n_unverifiable from h where age > months or months is null group by doc_id")
def retention_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = comply.overview(associated(spark, sf_dir), instances(spark, sf_dir), activities(spark), *_register(spark), now(), include_proposed=False)
    return _with_doc(o).select("doc_id", "n_flags", "worst_overdue_months", F.size("retention_unresolved").alias("n_unverifiable"))


@query("compliant_documents", _HELD + ", v as (select s.doc_id, len(list_filter(s.det, lambda x: not list_contains(s.dec, x))) = 0 and s.doc_id not in (select doc_id from h where age > months) as ok from s) select ok as compliant, count(*) as n from v group by ok")
def compliant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = comply.report(associated(spark, sf_dir), instances(spark, sf_dir), activities(spark), *_register(spark), now())
    return r.groupBy("compliant").agg(F.count("*").alias("n"))


@query("age_months", f"select doc_id, greatest(0, floor((date_diff('second', {_DATE_SQL}, timestamp '{NOW}') // 86400) / 30.44))::int as age_months from documents")
def age_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associated(spark, sf_dir).select("doc_id", dates.age_months(F.col("reference_date"), now()).alias("age_months"))


# --- freshness and registry -------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as they are now, and as the registry has them; both from doc_id."""
    d = documents(spark, sf_dir)
    t = F.unix_timestamp(now()) - F.col("doc_id") * 60
    files = d.where("doc_id % 7 <> 3").select("document_id", F.timestamp_seconds(t).alias("mtime"), F.length("text").cast("long").alias("size"))
    shift = F.when(F.col("doc_id") % 5 == 0, 3600.0).when(F.col("doc_id") % 5 == 1, 0.4).otherwise(0.0)
    old = d.where("doc_id % 11 <> 4").select(
        "document_id", F.timestamp_seconds(t - shift).alias("source_mtime"), (F.length("text") + (F.col("doc_id") % 13 == 2).cast("int")).cast("long").alias("source_size"),
        F.when(F.col("doc_id") % 17 == 1, "old").otherwise("new").alias("detector_signature"))
    return files, old


@query("needs_rescan", "select doc_id, (doc_id % 11 = 4 or doc_id % 17 = 1 or doc_id % 13 = 2 or doc_id % 5 = 0) as todo from documents where doc_id % 7 <> 3")
def needs_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_doc(freshness.compare(*_snapshots(spark, sf_dir), "new").select("document_id", "todo"))


@query("count_unchanged", "select count(*) filter (not (doc_id % 11 = 4 or doc_id % 13 = 2 or doc_id % 5 = 0)) as unchanged from documents where doc_id % 7 <> 3")
def count_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.unchanged(*_snapshots(spark, sf_dir))


@query("prune_candidates", f"select doc_id from documents where doc_id % 11 <> 4 and doc_id % 7 = 3 and doc_id in (select doc_id from ({ALL_FOUND}))")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, old = _snapshots(spark, sf_dir)
    return _with_doc(freshness.prune(files, old, instances(spark, sf_dir)))


@query("replace_scan", f"select pii_type, count(*) as n from (select pii_type from ({ALL_FOUND}) where doc_id % 2 = 1 union all select pii_type from ({ALL_FOUND}) where doc_id % 2 = 0 and pii_type <> 'email') group by pii_type")
def replace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are scanned again by an engine that no longer finds emails."""
    own = instances(spark, sf_dir)
    old = own.select("id", "document_id", "pii_type", "start", "end", F.lit(0.5).alias("confidence"), F.lit("single_source").alias("confirmation_level"), F.array(F.lit("regex")).alias("sources"), F.lit(None).cast("string").alias("processing_activity_id"), F.lit(0).cast("long").alias("last_scan_id"))
    none = lambda t: F.lit(None).cast(t)
    even = documents(spark, sf_dir).where("doc_id % 2 = 0").select("document_id", none("string").alias("path"), none("timestamp").alias("reference_date"), none("string").alias("reference_date_source"), none("timestamp").alias("source_mtime"), none("long").alias("source_size"), F.lit("x").alias("detector_signature"), now().alias("at"), F.lit(False).alias("clear_stamp"))
    found = own.where("doc_id % 2 = 0 and pii_type <> 'email'").select("document_id", F.col("id").alias("ord"), "pii_type", "start", "end", F.lit(0.5).alias("confidence"), F.lit("single_source").alias("level"), F.array(F.struct(F.lit("regex").alias("detector_id"))).alias("sources"))
    from .. import schemas

    new = registry.record_scan(spark.createDataFrame([], schemas.DOCUMENT), spark.createDataFrame([], schemas.SCAN), old, even, found)
    return new["instance"].groupBy("pii_type").agg(F.count("*").alias("n"))


@query("apply_coverage", f"select pii_type, count(*) filter (doc_id % 3 = 0) as covered, count(*) as n from ({ALL_FOUND}) group by pii_type")
def apply_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = instances(spark, sf_dir).withColumn("processing_activity_id", F.lit(None).cast("string"))
    done = registry.apply_coverage(own, own.where("doc_id % 3 = 0").select("id", F.lit("payroll").alias("activity_id")))
    return done.groupBy("pii_type").agg(F.count("processing_activity_id").alias("covered"), F.count("*").alias("n"))


_PDF_DATES = ("D:20190312101500+01'00'", "D:20190312101500-05'00'", "D:20190312101500Z", "D:20190312", "D:201903121015", "20190312101500", "", "not a date", "D:2019", "D:20191332000000Z")
_PDF_TIMES = ("2019-03-12 09:15:00", "2019-03-12 15:15:00", "2019-03-12 10:15:00", "2019-03-12 00:00:00", "2019-03-12 10:15:00", "2019-03-12 10:15:00", None, None, None, None)


@query("pdf_date_parse", """
with t(raw) as (values """ + ", ".join("('" + x.replace("'", "''") + "')" for x in _PDF_DATES) + r"""),
p as (select raw, regexp_extract(raw, '^D?:?(\d{8})(\d{0,6})', 1) as d, rpad(regexp_extract(raw, '^D?:?(\d{8})(\d{0,6})', 2), 6, '0') as h, regexp_extract(raw, '([+-])(\d\d)''', 1) as s, regexp_extract(raw, '([+-])(\d\d)''(\d\d)', 2) as hh, regexp_extract(raw, '([+-])(\d\d)''(\d\d)', 3) as mm from t)
select raw, strftime(try_strptime(nullif(d, '') || h, '%Y%m%d%H%M%S') - to_minutes(case when s = '' then 0 else (hh::int * 60 + mm::int) * case s when '-' then -1 else 1 end end), '%Y-%m-%d %H:%M:%S') as utc from p""")  # fmt: skip
def pdf_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(x,) for x in _PDF_DATES], "raw string")
    return d.select("raw", F.date_format(F.to_utc_timestamp(dates.pdf_date("raw"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("reference_date_pick", f"select doc_id, case when doc_id % 4 = 0 then 'content_metadata' when doc_id % 4 = 1 then 'content_metadata' else 'file_mtime' end as source, case when doc_id % 4 = 0 then 'pdf:modDate' when doc_id % 4 = 1 then 'pdf:creationDate' else 'fs:mtime' end as field, case when doc_id % 4 = 0 then date '2020-01-01' when doc_id % 4 = 1 then date '2019-06-01' else date '2026-01-01' - (doc_id % 500)::int end::varchar as day from documents")
def reference_date_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = lambda s: F.lit(s).cast("timestamp")
    mod = F.when(F.col("doc_id") % 4 == 0, ts("2020-01-01")).otherwise(ts("1980-01-01"))
    made = F.when(F.col("doc_id") % 4 == 1, ts("2019-06-01")).otherwise(ts("2031-01-01"))
    cands = F.array(F.struct(F.lit("pdf:modDate").alias("field"), mod.alias("value")), F.struct(F.lit("pdf:creationDate").alias("field"), made.alias("value")))
    mtime = F.timestamp_seconds(F.unix_timestamp(now()) - (F.col("doc_id") % 500) * 86400)
    r = dates.reference_date(cands, mtime, now())
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.source", "r.field", F.to_date("r.value").cast("string").alias("day"))


@query("upload_paths", "select page_id, case when page_id % 5 = 0 then null when page_id % 5 = 1 then null when page_id % 5 = 2 then 'a/b' || page_id || '.txt' when page_id % 5 = 3 then 'c/d.txt' else 'x.txt' end as path from pages")
def upload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import safe_relative

    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.lit("/etc/x")).when(k == 1, F.lit("a/../../x")).when(k == 2, F.concat(F.lit("a/./b"), "page_id", F.lit(".txt"))).when(k == 3, F.lit("c//d.txt")).otherwise(F.lit("x.txt"))
    return table(spark, sf_dir, "pages").select("page_id", safe_relative(raw).alias("path"))


# --- edits, faults and small reports ----------------------------------------------------

_ONE = 5


def _one_id(spark: SparkSession, sf_dir: str) -> str:
    return documents(spark, sf_dir).where(F.col("doc_id") == _ONE).first()["document_id"]


@query("assign_activities", f"select doc_id, case doc_id when {_ONE} then 'payroll,legal' else 'old' end as ids, case doc_id when {_ONE} then 'manual' end as association_source from documents")
def assign_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id", F.array(F.lit("old")).alias("activity_ids"), F.lit(None).cast("string").alias("association_source"))
    done = registry.assign_activities(d, _one_id(spark, sf_dir), ["payroll", "legal"])
    return _with_doc(done).select("doc_id", F.array_join("activity_ids", ",").alias("ids"), "association_source")


@query("save_rule", "select prefix, array_to_string(ids, ',') as ids from (values ('', ['records']), ('src1/en', ['contracts', 'payroll']), ('src2/', ['legal']), ('src3/de', ['ghost']), ('src1', ['legal', 'records'])) r(prefix, ids)")
def save_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = rules_frame(spark).withColumn("created_at", now())
    return registry.save_rule(old, " /src1/ ", ["legal", "records"], None).select("prefix", F.array_join("activity_ids", ",").alias("ids"))


@query("delete_rule", f"""
with m as (select doc_id, any_value(r.ids) as ids from documents d, {_RULES_SQL} where r.prefix not in ('', 'src1/en') and ({DOC_ID} = r.prefix or starts_with({DOC_ID}, r.prefix || '/')) group by doc_id),
s as (select d.doc_id, case doc_id % 3 when 0 then 'manual' when 1 then 'rule' end as src, m.ids from documents d left join m using (doc_id))
select doc_id, array_to_string(case when src = 'manual' then ['old'] when ids is not null then ids when src = 'rule' then []::varchar[] else ['old'] end, ',') as ids,
  case when src = 'manual' then src when ids is not null then 'rule' end as association_source from s""")  # fmt: skip
def delete_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "manual").when(F.col("doc_id") % 3 == 1, "rule")
    d = documents(spark, sf_dir).select("document_id", F.array(F.lit("old")).alias("activity_ids"), source.alias("association_source"))
    done, _ = registry.delete_rule(d, rules_frame(spark).where("prefix <> ''"), "src1/en/")
    return _with_doc(done).select("doc_id", F.array_join("activity_ids", ",").alias("ids"), "association_source")


@query("category_edits", f"""
select ctext as raw_text, case cid when 12 then 'iban' else array_to_string(types, ',') end as types, case when cid = 12 or mid = 5 then 'confirmed' else state end as mapping_state from {_CATS_SQL} where cid <> 42
union all values ('mobile', 'phone', 'proposed'), ('fax', '', 'proposed')""")  # fmt: skip
def category_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row gets a type, one is parted, one macro category is confirmed."""
    edited = register.split_category(register.update_category(categories(spark), 12, ["iban"]), 42, [("mobile", ["phone"]), ("fax", [])])
    return register.confirm_macro(edited, 5).select("raw_text", F.array_join("pii_types", ",").alias("types"), "mapping_state")


@query("declared_order", f"select aid as activity_id, string_agg(t, ',' order by o) as types from (select aid, t, min(cid * 100 + k) as o from (select m.aid, c.cid, unnest(c.types) as t, unnest(range(len(c.types))) as k from {_CATS_SQL} join {_MACROS_SQL} using (mid)) group by aid, t) group by aid")
def declared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = categories(spark).join(macros(spark).select(F.col("id").alias("macro_category_id"), "activity_id"), "macro_category_id")
    return register.declared_order(own.select("activity_id", F.col("id").alias("ord"), "pii_types")).select("activity_id", F.array_join("pii_types", ",").alias("types"))


@query("slugs", r"select c_custkey, case when c_custkey % 10 = 0 then 'activity' else regexp_replace(lower(trim(c_mktsegment || '  ' || c_name)), '\s+', '-', 'g') end as slug from customer")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit("  "), "c_name", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.slug(name).alias("slug"))


@query("inventory_by_format", "select case doc_id % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.docx' else '' end as format, count(*) as n from documents group by 1")
def inventory_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return registry.formats(documents(spark, sf_dir).select(F.concat("document_id", F.when(k == 0, ".PDF").when(k == 1, ".txt").when(k == 2, ".tar.docx").otherwise("")).alias("document_id")))


@query("handling_faults", "select doc_id, 'missing' as fault from documents where doc_id % 5 <> 0 and doc_id % 7 = 1 union all select doc_id, 'unexpected' from documents where doc_id % 5 = 0 and doc_id % 7 <> 1")
def handling_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    manifest = d.select("document_id", F.when(F.col("doc_id") % 5 == 0, "skipped").otherwise("scannable").alias("expectation"))
    return _with_doc(score.handling(manifest, d.where("doc_id % 7 <> 1").select("document_id"))).select("doc_id", "fault")


@query("retention_faults", f"""
with o as (select {DOC_ID} as d from documents where doc_id % 9 = 0), e(prefix) as (values ('src1'), ('src2/en'), ('nowhere'))
select prefix as what, 'silent' as fault from e where not exists (select 1 from o where starts_with(d, prefix || '/'))
union all select d, 'unexpected' from o where not exists (select 1 from e where starts_with(d, prefix || '/'))""")  # fmt: skip
def retention_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("src1",), ("src2/en",), ("nowhere",)], "prefix string")
    return score.retention_check(expected, documents(spark, sf_dir).where("doc_id % 9 = 0").select("document_id"))


@query("mapper_score", """
with c as (select sum((quality = 1)::int + (toxic = 0)::int)::bigint as tp, sum((quality <> 1)::int + (toxic <> 0)::int)::bigint as f from labels)
select tp, f as fp, f as fn, tp + f as support, round(tp / (tp + f)::double, 6) as precision, round(tp / (tp + f)::double, 6) as recall, round(tp / (tp + f)::double, 6) as f1 from c""")  # fmt: skip
def mapper_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string"))
    cases = table(spark, sf_dir, "labels").select(F.array(q, t, t).alias("got"), F.array(F.lit("q1"), F.lit("t0"), F.lit("q1")).alias("expected"))
    return score.mapper_counts(cases).select("tp", "fp", "fn", "support", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("extraction_tax", f"""
with {_VALUES}, x as (select doc_id, v, count(*) as n from d group by all), y as (select doc_id, v, count(*) as n from g group by all),
c as (select (select sum(n) from y) as ng, (select sum(n) from x) as na, (select sum(n) from x where doc_id % 2 = 0) as nb, (select sum(least(x.n, y.n)) from x join y using (doc_id, v)) as ta, (select sum(least(x.n, y.n)) from x join y using (doc_id, v) where doc_id % 2 = 0) as tb),
f as (select coalesce(2 * ta / (na + ng)::double, 0) as a, coalesce(2 * tb / (nb + ng)::double, 0) as b from c)
select round(a, 6) as f1_clean, round(b, 6) as f1_extracted, round(a - b, 6) as tax from f""")  # fmt: skip
def extraction_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if the extraction had lost the odd documents."""
    clean, gold = _value_sides(spark, sf_dir)
    t = score.extraction_tax(clean, clean.where("document_id % 2 = 0"), gold)
    return t.select(*[F.round(x, 6).alias(x) for x in ("f1_clean", "f1_extracted", "tax")])


@query("benchmark_rows", f"""{_SPAN_COUNTS}, o as ({_PRF})
select 'loose' as label, precision, recall, f1, 0.3::double as s_doc, null::double as wh_doc from o where pii_type = 'OVERALL' union all select 'same', 1, 1, 1, 0.6, 0.015""")  # fmt: skip
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _side(spark, sf_dir, "r")
    b = score.benchmark({"loose": (_side(spark, sf_dir, "n"), 30.0, None), "same": (gold, 60.0, 1.5)}, gold, 100)
    return b.select("label", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "s_doc", "wh_doc")])


@query("breach_share", _HELD + ' select count(*) filter (flags > 0) as breaches, count(*) as "rows" from (select doc_id, count(*) filter (age > months) as flags from h where age > months or months is null group by doc_id)')
def breach_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comply.breach_share(comply.overview(associated(spark, sf_dir), instances(spark, sf_dir), activities(spark), *_register(spark), now(), include_proposed=False))


@query("check_document", _VERDICT_CTE + f" select doc_id, array_to_string(list_filter(det, lambda x: not list_contains(dec, x)), ',') as orphan, array_to_string(list_filter(det, lambda x: list_contains(dec, x)), ',') as covered, array_to_string(list_filter(dec, lambda x: not list_contains(det, x)), ',') as missing from s where doc_id = {_ONE}")
def check_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = comply.check_document(_one_id(spark, sf_dir), associated(spark, sf_dir), instances(spark, sf_dir), activities(spark), *_register(spark), now())
    return _with_doc(r).select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("orphan", "covered", "missing")])


@query("retention_without_months", f"select doc_id, 'legal' as activity_id, 'Identity' as category, null::int as retention_months from documents where doc_id % 2 = 0 and starts_with({DOC_ID}, 'src2/')")
def retention_without_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents hold an e-mail address; one activity declares these without a retention."""
    held = documents(spark, sf_dir).where("doc_id % 2 = 0").select("document_id", F.col("doc_id").alias("id"), F.lit("email").alias("pii_type"))
    r = comply.retention(associated(spark, sf_dir), held, *_register(spark), now())
    return _with_doc(r.where("unverifiable")).select("doc_id", "activity_id", "category", "retention_months")


# --- literal cases, the order of a scan, windows of time --------------------------------

#: (text, type and value of each finding).  The blanks and the letter outside of the basic plane tell code points from units.
_CASES = (
    ("\U0001f600 pay CH93 0076 2011 6238 5295 7, now", (("iban", "CH93 0076 2011 6238 5295 7"), ("credit_card", "0076 2011 6238 5295 7"))),
    ("IBAN DE89370400440532013000; code RSSMRA85T10A562S.", (("iban", "DE89370400440532013000"), ("italian_id", "RSSMRA85T10A562S"))),
    ("\u00e9t\u00e9 756.9217.0769.85 / 7569217076985!", (("credit_card", "7569217076985"), ("swiss_avs", "756.9217.0769.85"), ("swiss_avs", "7569217076985"))),
    ("card 4111-1111-1111-1111, host 192.0.2.17.", (("credit_card", "4111-1111-1111-1111"), ("ip_address", "192.0.2.17"))),
    ("mail anna.keller@example.org, thanks", (("email", "anna.keller@example.org"),)),
    ("nothing 757.9217.0769.85, no CH9, no RSSMRA85Z10A562S", ()),
    ("", ()),
)
_CASE_ROWS = [(i, kind, value, text) for i, (text, found) in enumerate(_CASES) for kind, value in found]


@query("rule_literals", "select n, pii_type, (strpos(text, value) - 1)::int as start, (strpos(text, value) - 1 + length(value))::int as \"end\", value from (values " + ", ".join(f"({i}, '{k}', '{v}', '{t}')" for i, k, v, t in _CASE_ROWS) + ") c(n, pii_type, value, text)")
def rule_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on texts with known findings, exact ends included."""
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_CASES)], "n int, text string")
    c = detect.explode_candidates(d.select("n", detect.rule_candidates("text").alias("c")), "c")
    return c.select("n", "pii_type", "start", "end", F.col("text").alias("value"))


@query("scan_matches", f"select document_id, {_IN_ORDER}, start, rtrim(value, ' ') as value, pii_type, confidence, 'single_source' as level from ({' union all '.join(_SHARED_SQL)})")
def scan_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of documents with patterns alone: rule by rule, each leftmost first."""
    m = jobs.scan_documents(documents(spark, sf_dir).select("document_id", "text"), SHARED)
    return m.select("document_id", "ord", "start", F.rtrim("text").alias("value"), "pii_type", "confidence", "level")


@query("counts_by_window", f"select strftime(time_bucket(interval '10 minutes', timestamp '{NOW}' - to_minutes(doc_id::int)), '%Y-%m-%d %H:%M') as start, pii_type, count(*) as n from ({ALL_FOUND}) group by all")
def counts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import ingest

    at = F.timestamp_seconds(F.unix_timestamp(now()) - F.col("doc_id") * 60)
    found = ingest.scan_stream(documents(spark, sf_dir).select("document_id", "text", at.alias("at")))
    return ingest.counts_by_window(found).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "pii_type", "n")


@query("chunk_health", "select count(*) as chunks_seen, count(*) filter (least(2000, length(text) - 1800 * k) % 2 = 1) as chunks_failed from (select text, unnest(range(1 + greatest(0, ceil((length(text) - 2000) / 1800.0))::int)) as k from documents where length(text) > 0)")
def chunk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted backend that answers windows of even length and fails on the others."""

    def backend():
        def chat(prompt: str) -> str:
            if len(prompt.partition("Text:\n")[2]) % 2:
                raise TimeoutError
            return "none: []"

        return chat

    return detect.chunk_health(detect.ask(detect.windows(documents(spark, sf_dir).select("document_id", "text")), backend))


@query("report_cells", r"select doc_id, case when length(v) > 32 then substr(v, 1, 29) || '...' else v end as cell from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as v from documents)")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cell("text").alias("cell"))


@query("register_table", f"select a.aid as activity_id, m.mtext as macro_text, c.ctext as category_text, array_to_string(c.types, ',') as types, c.state as mapping_state from (values ('payroll'), ('records'), ('legal'), ('contracts'), ('hiring'), ('idle')) a(aid) left join {_MACROS_SQL} on m.aid = a.aid left join {_CATS_SQL} on c.mid = m.mid")
def register_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register as one table; an activity without categories stays."""
    own = activities(spark)
    idle = spark.createDataFrame([("idle",)], "id string")
    flat = register.flat(own.select("id").unionByName(idle).distinct(), macros(spark), categories(spark))
    return flat.select("activity_id", "macro_text", "category_text", F.array_join("pii_types", ",").alias("types"), "mapping_state")
