"""Guidance corpus, retrieval, urgency, explanation texts and prompts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data.profiles import CARGO_TYPES
from ..functions import text
from ..functions.numeric import round_to
from ..operators import decisions, explain, retrieval
from ..session import materialise, work_path
from ..sources import guidance, messages
from ..sources.leveled import LeveledTable
from .decide import DECIDED, decided
from .registry import query, rounded
from .tables import Tables


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _builtin_sql() -> str:
    """The built-in documents for the check: fixed rows and the cargo template."""
    rows = [json.loads(line) for line in (guidance.DATA / "guidance_documents.jsonl").read_text(encoding="utf-8").splitlines()]
    notes = json.loads((guidance.DATA / "cargo_notes.json").read_text(encoding="utf-8"))
    values = [(r["id"], r["title"], r["content"], r["source"], r["category"], r["cargo_type"], r["document_type"]) for r in rows]
    for cargo in (c.replace("_", "") for c in CARGO_TYPES):
        shown = text.CARGO_DISPLAY_NAMES.get(cargo, cargo.capitalize())
        values.append((
            f"sop-cargo-{cargo}", guidance.CARGO_TITLE % shown, guidance.CARGO_CONTENT % (notes[cargo], shown),
            "Internal Cargo Policy", "cargo", cargo, "profile",
        ))
    body = ",\n".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in values)
    return f"builtin(id, title, content, source, category, cargo_type, document_type) as (values {body})"


TITLE = """
substr(coalesce(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'),
  lambda l: regexp_replace(regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '^#+', ''), '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')[1],
  'Document ' || doc_id), 1, 140)
"""

EXTERNAL = f"""
external as (
 select 'external-text-' || substr(sha1(source || '/' || doc_id), 1, 12) as id,
  regexp_replace(regexp_replace({TITLE}, '\\s+', ' ', 'g'), '^ +| +$', '', 'g') as title,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') as content, 'External SOP File: ' || source as source, lang as category, 'all' as cargo_type, doc_id
 from documents)
"""


def external(t: Tables) -> DataFrame:
    """The document table as external guidance documents."""
    d = t.read("documents")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    default = {k: F.lit(v) for k, v in guidance.FILE_DEFAULTS.items()}
    return guidance.tidy(d.select(
        text.stable_id("external-text", key).alias("id"),
        text.first_line("text", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("External SOP File: "), "source").alias("source"),
        F.col("lang").alias("category"),
        default["type"].alias("document_type"),
        *[default[f].alias(f) for f in ("cargo_type", "scenario", "risk_band", "actions", "fields")],
        F.concat(F.lit("external sop "), text.slug("source")).alias("keywords"),
        F.lit(5).alias("priority"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
    ))


def corpus(t: Tables) -> DataFrame:
    return guidance.merge(guidance.builtin_documents(t.spark), external(t))


@query(
    "corpus_summary",
    f"""with {_builtin_sql()}, {EXTERNAL}, merged as (
      select id, category, source, cargo_type from builtin union all select id, category, source, cargo_type from external)
    select 'categories' as section, category as key, count(*) as documents from merged group by category union all
    select 'sources', source, count(*) from merged group by source union all
    select 'cargo_types', cargo_type, count(*) from merged group by cargo_type union all
    select 'document_count', '', count(*) from merged""",
)
def corpus_summary(t: Tables) -> DataFrame:
    return guidance.summary(corpus(t))


@query(
    "doc_ids",
    f"""with {EXTERNAL} select doc_id, id, title, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') as slug,
    length(title || chr(10) || chr(10) || content) as search_chars from external""",
)
def doc_ids(t: Tables) -> DataFrame:
    found = guidance.search_text(external(t))
    return found.select(
        F.col("path").cast("bigint").alias("doc_id"), "id", "title", text.slug("title").alias("slug"),
        F.length("document").cast("bigint").alias("search_chars"),
    )


@query(
    "corpus_upsert",
    """with loaded as (
      select 'doc-' || doc_id as id, lang as category, 1 as version, n_chars from documents union all
      select 'doc-' || d.doc_id, 'label-' || l.quality, 2, d.n_chars from documents d join labels l on d.doc_id = l.doc_id)
    select id, category, version, n_chars from loaded qualify row_number() over (partition by id order by version desc) = 1""",
)
def corpus_upsert(t: Tables) -> DataFrame:
    """Documents loaded twice into the stored corpus, the labelled version replacing the first."""
    return loaded_corpus(t).read()


def loaded_corpus(t: Tables) -> LeveledTable:
    d = t.read("documents")
    first = d.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.col("lang").alias("category"), F.lit(1).alias("version"), "n_chars")
    second = d.join(t.read("labels"), "doc_id").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.concat(F.lit("label-"), "quality").alias("category"), F.lit(2).alias("version"), "n_chars"
    )
    table = LeveledTable(t.spark, work_path(t.spark, "corpus"), ["id"], ["version"])
    table.write(first, 0)
    table.write(second, 1)
    return table


@query(
    "corpus_changes",
    "select 'doc-' || d.doc_id as id, 'label-' || l.quality as category, 2 as version, d.n_chars, cast(1 as bigint) as batch from documents d join labels l on d.doc_id = l.doc_id",
)
def corpus_changes(t: Tables) -> DataFrame:
    """What the second load of the corpus changed, as its feed gives it."""
    return loaded_corpus(t).changes(0)


@query(
    "clean_metadata",
    """select event_id, case when event_type = 'error' then 2 else 3 end as entries, case when event_type = 'error' then null else event_type end as type,
     '{"k": ' || json_extract_string(props, '$.k') || '}' as props from events""",
)
def clean_metadata(t: Tables) -> DataFrame:
    """Event metadata without null entries, nested JSON on one line."""
    wide = F.replace("props", F.lit(" "), F.lit(" \n  "))
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    meta = F.create_map(F.lit("type"), kind, F.lit("props"), wide, F.lit("value"), F.col("value").cast("string"))
    return t.events.withColumn("m", guidance.clean_metadata(meta)).select(
        "event_id", F.size("m").alias("entries"), F.try_element_at("m", F.lit("type")).alias("type"), F.col("m")["props"].alias("props")
    )


@query(
    "vector_topk",
    f"""with parts as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings),
    centres as (select label, i, avg(cast(x as double)) as c from parts group by label, i),
    rows as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings),
    pairs as (select label, vec_id, {rounded('sum((x - c) * (x - c))', 6)} as distance from rows join centres using (i) group by label, vec_id)
    select label as query_id, vec_id as doc_id, distance, cast(row_number() over (partition by label order by distance, vec_id) as integer) as rank from pairs
    qualify row_number() over (partition by label order by distance, vec_id) <= 5""",
)
def vector_topk(t: Tables) -> DataFrame:
    """The five vectors nearest to the mean vector of each label."""
    e = t.read("embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
        # One entry per dimension of the vectors.
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("m"))
        .select(F.col("label").alias("query_id"), F.transform("m", lambda s: s["c"]).alias("vector"))
    )
    rows = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.top_n(means, rows, 5).select("query_id", "doc_id", "distance", "rank")


URGENT = f"""{DECIDED},
urgencies as (
 select *, case when door_open and combined_score >= 0.70 and timed = 'moderate' then 'high' else timed end as urgency from (
  select *, case when time_to_failure_hours <= 1 then 'critical' when time_to_failure_hours <= 3 and lifted_no < 3 then 'high'
    else ['low', 'moderate', 'high', 'critical'][lifted_no] end as timed from (
   select *, case when refrigeration_failed and no < 3 then no + 1 else no end as lifted_no from (
    select *, case when combined_score >= 0.95 then 4 when combined_score >= 0.75 then 3 when combined_score >= 0.40 then 2 else 1 end as no from taken))))
"""

QUERY_TEXT = """
asked as (
 select *, 'cargo ' || cargo_type || ' | scenario ' || scenario || format(' | temperature {:.2f}C | humidity {:.2f} | vibration {:.2f}g | risk {:.3f}',
   temperature, humidity, vibration, combined_score) || ' | urgency ' || urgency || ' | temperature monitoring protocol | spoilage assessment guideline'
  || case when door_open then ' | door opening protocol' else '' end
  || case when refrigeration_failed or scenario = 'refrigeration_failure' then ' | refrigeration failure response backup cooling' else '' end
  || case when humidity >= 70 or humidity <= 20 then ' | humidity control guidelines' else '' end
  || case when vibration >= 5 then ' | vibration exposure limits inspection' else '' end
  || case when risk_level in ('high', 'critical') and target_dc is not null then ' | emergency rerouting nearest distribution center' else '' end
  || case when risk_level <> 'low' then ' | cooling adjustment response' else '' end
  || case when len(factors) > 0 then ' | ' || array_to_string(factors, ' | ') else '' end
  || case when temp_degree_minutes > 0 then ' | cumulative temperature exposure' else '' end
  || case when door_open_minutes > 0 then ' | cumulative door opening' else '' end
  || case when vibration_critical_minutes > 0 then ' | critical vibration exposure' else '' end
  || coalesce(format(' | time to failure {:.2f} hours', time_to_failure_hours), '') as retrieval_query
 from urgencies)
"""


def urgent_decided(t: Tables, numbered: bool = False) -> DataFrame:
    return explain.with_urgency(decided(t, numbered))


@query("urgency", f"with {URGENT} select asset_id, prediction_id, urgency from urgencies")
def urgency(t: Tables) -> DataFrame:
    return urgent_decided(t).select("asset_id", "prediction_id", "urgency")


@query("retrieval_query", f"with {URGENT}, {QUERY_TEXT} select asset_id, prediction_id, retrieval_query from asked")
def retrieval_query(t: Tables) -> DataFrame:
    return explain.retrieval_query(urgent_decided(t)).select("asset_id", "prediction_id", "retrieval_query")


EXPLAINED = """
described as (select asset_id, prediction_id, string_agg(description, '; ' order by place) filter (where place < 3) as acts from action_rows group by all),
explained as (
 select u.asset_id, u.prediction_id, d.acts, u.risk_level,
  'Risk is ' || urgency || ' for asset ' || u.asset_id || ' because ' || coalesce(nullif(array_to_string(list_filter([
    case when refrigeration_failed then 'refrigeration failure is active' end,
    case when door_open then 'a door-open event is present' end,
    case when temperature > 8 then format('temperature is elevated at {:.2f}C', temperature) end,
    case when humidity >= 70 then format('humidity is high at {:.2f}%', humidity) end,
    case when vibration >= 5 then format('vibration is elevated at {:.2f}g', vibration) end,
    case when temp_degree_minutes > 0 then 'cumulative temperature exposure has built up' end,
    case when door_open_minutes > 0 then 'door-open exposure has accumulated' end], lambda f: f is not null), '; '), ''),
    'the current telemetry and model output indicate developing spoilage risk')
  || format('. Combined risk score is {:.3f}.', combined_score)
  || coalesce(format(' Estimated time to failure is about {:.2f} hours.', time_to_failure_hours), '')
  || ' Recommended actions: ' || d.acts || '.' as explanation
 from urgencies u join described d on u.asset_id = d.asset_id and u.prediction_id = d.prediction_id)
"""


@query("explanation_text", f"with {URGENT}, {EXPLAINED} select asset_id, prediction_id, explanation from explained")
def explanation_text(t: Tables) -> DataFrame:
    return explain.risk_explanation(urgent_decided(t)).select("asset_id", "prediction_id", "explanation")


@query(
    "decision_explanation",
    f"""with {URGENT}, {EXPLAINED} select asset_id, prediction_id, 'The autonomous system treated this case as ' || risk_level || ' risk and selected ' || acts
    || ' based on the current telemetry, predicted spoilage trend, and operating scenario. These actions align with the retrieved SOP guidance, especially no matched SOP IDs.' as explanation
    from explained""",
)
def decision_explanation(t: Tables) -> DataFrame:
    return explain.decision_explanation(urgent_decided(t)).select(
        "asset_id", "prediction_id", F.col("decision_explanation").alias("explanation")
    )


TOP_DOCUMENTS = 4


def with_query_key(cases: DataFrame) -> DataFrame:
    """Cases with the digest of their query's shape, which is made faster than its signature; ``asked_queries`` has the query of each."""
    return cases.withColumn("query_key", F.md5(retrieval.shape("retrieval_query")))


def asked_queries(cases: DataFrame) -> DataFrame:
    """(query_key, query_id, text): the distinct shapes of the cases' queries with their signature and its digest, written once."""
    shapes = cases.select(retrieval.shape("retrieval_query").alias("shape")).distinct()
    signed = shapes.select(F.md5("shape").alias("query_key"), retrieval.signature("shape").alias("text"))
    return materialise(signed.select("query_key", F.md5("text").alias("query_id"), "text"), "signatures")


def found_documents(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Best documents for every distinct query signature, which is known by its digest."""
    signatures = asked.select("query_id", "text").distinct()
    return retrieval.text_top_n(signatures, texts.select(F.col("id").alias("doc_id"), F.col("document").alias("text")), TOP_DOCUMENTS)


def corpus_texts(t: Tables) -> DataFrame:
    """The corpus as it is searched and shown, written once."""
    return materialise(guidance.search_text(corpus(t)).select("id", "document", "source", "category", "document_type"), "corpus")


FOUND = f"""{QUERY_TEXT}, {_builtin_sql()}, {EXTERNAL},
    texts as (select id as doc_id, title || chr(10) || chr(10) || content as text from builtin union all select id, title || chr(10) || chr(10) || content from external),
    asked_words as (select distinct array_to_string(list_sort(regexp_extract_all(lower(retrieval_query), '\\p{{L}}+')), ' ') as query_id from asked),
    counts as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as term from texts) group by all),
    weights as (select term, ln((1.0 + (select count(*) from texts)) / (1.0 + count(*))) + 1.0 as idf from counts group by term),
    doc_weights as (select doc_id, term, tf * idf as w from counts join weights using (term)),
    doc_norms as (select doc_id, sqrt(sum(w * w)) as norm from doc_weights group by doc_id),
    query_counts as (select query_id, term, count(*) as tf from (select query_id, unnest(string_split(query_id, ' ')) as term from asked_words) group by all),
    query_weights as (select query_id, term, tf * idf as w from query_counts join weights using (term)),
    query_norms as (select query_id, sqrt(sum(w * w)) as norm from query_weights group by query_id),
    dots as (select q.query_id, d.doc_id, sum(q.w * d.w) as dot from query_weights q join doc_weights d using (term) group by all),
    text_scored as (select query_id, doc_id, {rounded('1.0 - dot / (qn.norm * dn.norm)', 6)} as distance from dots join query_norms qn using (query_id) join doc_norms dn using (doc_id)),
    found as (
     select query_id, doc_id, distance, cast(row_number() over (partition by query_id order by distance, doc_id) as integer) as rank from text_scored
     qualify row_number() over (partition by query_id order by distance, doc_id) <= {TOP_DOCUMENTS})"""


@query("text_topk", f"with {URGENT}, {FOUND} select md5(query_id) as query_id, doc_id, distance, rank from found")
def text_topk(t: Tables) -> DataFrame:
    """Best documents for the retrieval queries of all decisions."""
    cases = explain.retrieval_query(urgent_decided(t))
    return found_documents(asked_queries(cases), corpus_texts(t)).select("query_id", "doc_id", "distance", "rank")


def shown_documents(t: Tables, cases: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, sops): the documents found for each distinct query of the cases, best first, whole; ``key`` is query_id or query_key."""
    asked, documents = asked_queries(cases), corpus_texts(t)
    found = materialise(found_documents(asked, documents), "found")
    # Few documents are found for many queries; only these are moved.
    wanted = materialise(found.select(F.col("doc_id").alias("id")).distinct(), "wanted")
    if key != "query_id":
        found = found.join(asked.select("query_id", key), "query_id")
    details = found.join(documents.join(wanted, "id", "left_semi"), found["doc_id"] == F.col("id")).select(
        key,
        F.struct("rank", "id", F.col("document").alias("content"), "source", "category", F.col("document_type").alias("type")).alias("d"),
    )
    # At most TOP_DOCUMENTS rows per query.
    return details.groupBy(key).agg(F.array_sort(F.collect_list("d")).alias("sops"))


def explained_cases(t: Tables, numbered: bool = False) -> DataFrame:
    """Decided cases with the documents found for them, best first.

    The cases are written without documents and meet them in the last join, so no step after it should move its rows. Their offers,
    from which the actions were made, are written already and not moved along.
    """
    asked = explain.retrieval_query(urgent_decided(t, numbered)).drop("alternatives", "recommended_dc")
    cases = materialise(with_query_key(asked), "asked")
    joined = cases.join(shown_documents(t, cases, "query_key"), "query_key", "left")
    return joined.withColumn("sop_ids", F.transform(F.coalesce("sops", F.array()), lambda d: d["id"])).drop("query_key")


SIGNATURE = "array_to_string(list_sort(regexp_extract_all(lower(retrieval_query), '\\p{L}+')), ' ')"

SHOWN = f"""{FOUND}, {EXPLAINED},
    documents_of as (select id, title || chr(10) || chr(10) || content as text, source, category, document_type as type from builtin union all
     select id, title || chr(10) || chr(10) || content, source, category, 'sop' from external),
    sops as (
     select query_id, string_agg(doc_id, ', ' order by rank) as ids, string_agg(doc_id, '|' order by rank) as piped, count(*) as n,
      string_agg(doc_id, ', ' order by rank) filter (rank <= greatest(2, (select max(rank) from found f where f.query_id = found.query_id) - 1)) as few
     from found group by query_id),
    numbered as (select asset_id, prediction_id, 'DECISION_' || lpad(cast(row_number() over (order by matched_ts, asset_id, prediction_id) as varchar), 6, '0') as decision_id from taken),
    shown as (
     select a.*, n.decision_id, e.explanation || coalesce(' Relevant SOPs: ' || s.ids || '.', '') as risk_text, coalesce(s.piped, '') as sop_ids, s.ids, s.few,
      'The autonomous system treated this case as ' || a.risk_level || ' risk and selected ' || e.acts
       || ' based on the current telemetry, predicted spoilage trend, and operating scenario. These actions align with the retrieved SOP guidance, especially ' as decision_text
     from asked a join explained e on a.asset_id = e.asset_id and a.prediction_id = e.prediction_id
     join numbered n on a.asset_id = n.asset_id and a.prediction_id = n.prediction_id left join sops s on s.query_id = {SIGNATURE})"""


@query(
    "explanations_with_documents",
    f"""with {URGENT}, {SHOWN} select asset_id, prediction_id, {rounded('combined_score', 3)} as risk_score, urgency, risk_text as explanation,
    decision_text || coalesce(ids, 'no matched SOP IDs') || '.' as decision_explanation, sop_ids, retrieval_query from shown""",
)
def explanations_with_documents(t: Tables) -> DataFrame:
    shown = explain.decision_explanation(explain.risk_explanation(explained_cases(t)))
    return shown.select(
        "asset_id", "prediction_id", round_to("combined_score", 3).alias("risk_score"), "urgency", "explanation",
        "decision_explanation", F.array_join("sop_ids", "|").alias("sop_ids"), "retrieval_query",
    )


def recorded(t: Tables) -> DataFrame:
    """Explained cases with the number of their decision, which they have before documents are added to them."""
    shown = explain.risk_explanation(explained_cases(t, numbered=True))
    return shown.withColumn("decision_id", decisions.numbered("DECISION_", F.col("decision_no")))


RECORD = f"""asset_id, decision_id, urgency, {rounded('combined_score', 3)} as risk_score, matched_ts as ts, retrieval_query, sop_ids,
    temperature as snapshot_temperature, scenario as snapshot_scenario, temp_degree_minutes as snapshot_degree_minutes, risk_level as snapshot_level,
    predicted_score as snapshot_predicted, ts as snapshot_ts, 'rag-service-1' as service, 'coldchain' as prefix"""


# What is read from a received record; the message is decoded once, whatever is asked of it.
RECEIVED = """asset_id string, decision_id string, urgency string, risk_score double, ts string, retrieval_query string, explanation_text string,
    referenced_sops array<string>, sop_details array<struct<id: string>>,
    telemetry_snapshot struct<ts: string, temperature: double, scenario: string, cumulative_exposure: struct<temp_degree_minutes: double>>,
    prediction_snapshot struct<predicted_risk_proxy: double>, decision_snapshot struct<analysis: struct<risk_level: string>>,
    ragservicemetadata struct<serviceid: string, mqttprefix: string>, explanation_id string, prediction_timestamp string"""


def received_records(made: DataFrame, kind: str, text_name: str) -> DataFrame:
    """Records sent as messages and read back from their JSON."""
    sent = messages.publish(made, f"{kind}s", metadata=messages.service_metadata(kind, "rag-service-1", "ts"))
    return read_records(sent, text_name)


def read_records(sent: DataFrame, text_name: str) -> DataFrame:
    """Fields of received records; a message that is no object gives nulls."""
    snapshot = "r.telemetry_snapshot"
    return sent.select(F.from_json("value", RECEIVED).alias("r")).select(
        "r.asset_id", "r.decision_id", "r.urgency", "r.risk_score", F.col("r.ts").cast("timestamp").alias("ts"),
        "r.retrieval_query", F.col("r.explanation_text").alias(text_name),
        F.array_join("r.referenced_sops", "|").alias("sop_ids"),
        # A record without documents has no details, as the check has it.
        F.coalesce(F.array_join(F.transform("r.sop_details", lambda d: d["id"]), "|"), F.when(F.size("r.referenced_sops") == 0, "")).alias("detail_ids"),
        F.col(f"{snapshot}.temperature").alias("snapshot_temperature"), F.col(f"{snapshot}.scenario").alias("snapshot_scenario"),
        F.col(f"{snapshot}.cumulative_exposure.temp_degree_minutes").alias("snapshot_degree_minutes"),
        F.col("r.decision_snapshot.analysis.risk_level").alias("snapshot_level"),
        F.col("r.prediction_snapshot.predicted_risk_proxy").alias("snapshot_predicted"),
        F.col(f"{snapshot}.ts").cast("timestamp").alias("snapshot_ts"),
        F.col("r.ragservicemetadata.serviceid").alias("service"), F.col("r.ragservicemetadata.mqttprefix").alias("prefix"),
        "r.explanation_id", F.col("r.prediction_timestamp").cast("timestamp").alias("prediction_timestamp"),
    )


@query(
    "explanation_records",
    f"""with {URGENT}, {SHOWN} select {RECORD}, risk_text as explanation_text, sop_ids as detail_ids,
    'EXP-' || (epoch_us(matched_ts) // 1000) as explanation_id, prediction_ts as prediction_timestamp from shown""",
)
def explanation_records(t: Tables) -> DataFrame:
    """Whole explanation records as they are published and received."""
    return received_records(explain.explanation_records(recorded(t)), "prediction-explanation", "explanation_text")


@query(
    "decision_explanation_records",
    f"""with {URGENT}, {SHOWN} select {RECORD.replace('sop_ids', "coalesce(replace(few, ', ', '|'), '') as sop_ids")}, decision_text || coalesce(few, 'no matched SOP IDs') || '.' as explanation_text,
    coalesce(replace(few, ', ', '|'), '') as detail_ids from shown""",
)
def decision_explanation_records(t: Tables) -> DataFrame:
    """Whole justifications of decisions as they are published and received."""
    made = received_records(explain.decision_explanation_records(recorded(t)), "decision-explanation", "explanation_text")
    return made.drop("explanation_id", "prediction_timestamp")


@query(
    "sop_context",
    f"""with {URGENT}, {SHOWN} select md5(query_id) as query_id, string_agg('[' || id || '] ' || regexp_replace(text, '^ +| +$', '', 'g') || ' (source=' || source || ', category=' || category
     || ', type=' || type || ')', chr(10) order by rank) as context from found join documents_of on id = doc_id group by query_id""",
)
def sop_context(t: Tables) -> DataFrame:
    """The block of guidance that goes into the prompts, for each distinct query."""
    return shown_documents(t, explain.retrieval_query(urgent_decided(t))).select("query_id", explain.sop_context("sops").alias("context"))


@query("prompt_table")
def prompt_table(t: Tables) -> DataFrame:
    return explain.prompts(explained_cases(t)).select(
        "asset_id", "prediction_id", "risk_system", "risk_user", "decision_system", "decision_user"
    )
