"""Registry of the engine's queries, and the canonical tables they run on.

The canonical tables of a coding project (items, turns, segments, themes,
codes, predictions and so on) are derived from the driver's tables by SELECTs
that Spark and DuckDB both read, so a query and its oracle start from the same
rows.  Operators take DataFrames; the registered queries feed them these.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CANONICAL = {
    "items": """select source as dataset_id, cast(doc_id as string) as item_id, 'group ' || source as group_name, lang as person_name,
        'Talk ' || cast(doc_id % 50 as string) as item_title, cast(date '2024-01-01' + cast(doc_id % 30 as int) as string) as publish_date,
        cast(n_chars as string) as view_count, case when doc_id % 6 = 0 then null else cast(doc_id % 100 as string) end as like_count, text as transcript_text, doc_id from documents""",
    "segments": """select cast(doc_id as string) || ':0000' as segment_id, source as dataset_id, cast(doc_id as string) as item_id, 'group ' || source as group_name, lang as person_name,
        case doc_id % 4 when 0 then 'interviewer' when 1 then 'subject' when 2 then null else 'other' end as speaker_role,
        text, case when doc_id % 17 = 0 then null else cast(floor(n_chars / 40) as int) end as word_count, doc_id from documents""",
    "themes": """select * from (values ('s__any', 's', cast(null as string), 'Any', 0, 'active', '2024-01-01', 'include this', 'not that', 'a description of at least fifteen words so that the completeness rule finds the theme well described here'),
        ('s__quality', 's', 's__any', 'Quality', 1, 'active', '2024-01-02', 'include', cast(null as string), 'short description'),
        ('s__toxic', 's', 's__any', 'Toxic', 1, 'active', '2024-01-15', cast(null as string), cast(null as string), cast(null as string)),
        ('s__mild', 's', 's__toxic', 'Mild', 2, 'active', '2024-01-20', 'in', 'out', 'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen'),
        ('s__old', 's', 's__quality', 'Old', 2, 'archived', '2024-01-03', 'x', 'y', 'old')) as t(theme_id, scheme_id, parent_theme_id, name, depth, status, created_at, inclusion_criteria, exclusion_criteria, description)
        union all select 'r__' || cast(r_regionkey as string), 'r', cast(null as string), r_name, 0, 'active', '2024-01-01', 'anything of ' || r_name, cast(null as string), 'a part of the world' from region
        union all select 'n__' || cast(n_nationkey as string), 'r', 'r__' || cast(n_regionkey as string), n_name, 1, case when n_nationkey % 9 = 4 then 'archived' else 'active' end, '2024-01-05', n_name, 'elsewhere', cast(null as string) from nation
        union all select distinct 'c__' || cast(c_nationkey as string) || '_' || lower(c_mktsegment), 'r', 'n__' || cast(c_nationkey as string), c_mktsegment, 2, 'active', '2024-01-20', cast(null as string), cast(null as string), 'a trade of one nation' from customer""",
    "codes": """select doc_id * 10 + 1 as code_id, cast(doc_id as string) || ':0000' as segment_id, 's__quality' as theme_id, 'coder' || cast(doc_id % 2 as string) as coder,
            '2024-02-' || right('0' || cast(1 + doc_id % 28 as string), 2) as created_at, case when doc_id % 11 = 0 then '2024-03-01' end as deleted_at, doc_id % 5 = 0 as is_exemplar, doc_id from labels where quality = 1
        union all select doc_id * 10 + 2, cast(doc_id as string) || ':0000', case when doc_id % 3 = 0 then 's__mild' else 's__toxic' end, 'coder0', '2024-02-10', case when doc_id % 11 = 0 then '2024-03-01' end, doc_id % 2 = 0, doc_id from labels where toxic = 1""",
    "negatives": """select doc_id * 10 + 3 as negative_id, cast(doc_id as string) || ':0000' as segment_id, 's__quality' as theme_id, 'coder0' as coder, '2024-02-05' as created_at,
            case when doc_id % 13 = 0 then '2024-03-02' end as deleted_at, doc_id % 2 = 0 as is_near_miss, doc_id from labels where quality = 0
        union all select doc_id * 10 + 4, cast(doc_id as string) || ':0000', case when doc_id % 4 = 0 then 's__any' else 's__toxic' end, 'coder1', '2024-02-06', case when doc_id % 13 = 0 then '2024-03-02' end, doc_id % 3 = 0, doc_id from labels where toxic = 0 and doc_id % 2 = 0""",
    "item_reviews": """select doc_id as review_id, source as dataset_id, cast(doc_id as string) as item_id, 's' as scheme_id, case when doc_id % 2 = 0 then '2024-01-10' else '2024-02-20' end as marked_at,
        case when doc_id % 9 = 0 then '2024-03-01' end as unmarked_at, case when doc_id % 6 = 3 then null when doc_id % 2 = 0 then '2024-01-10' else '2024-02-25' end as recorded_at,
        case when doc_id % 15 = 0 then '2024-02-26' end as read_in_full_confirmed_at from documents where doc_id % 3 = 0""",
    "none_confirmations": """select cast(doc_id as string) || ':0000' as segment_id, 's' as scheme_id, '2024-02-21' as confirmed_at, case when doc_id % 14 = 0 then '2024-03-03' end as unconfirmed_at from documents where doc_id % 7 = 0""",
    "predictions": """select segment_id, theme_id, model_version, round(cast((doc_id * 7919 + k * 104729) % 1000 as double) / 1000, 3) as score,
            case when doc_id % 7 = 0 then null else round(cast((doc_id * 6007 + k * 15485863) % 1000 as double) / 1000, 3) end as oof_score, doc_id
        from segments cross join (values ('s__quality', 'tfidf_v2', 1), ('s__toxic', 'tfidf_v2', 2), ('s__mild', 'tfidf_v2', 3), ('s__quality', 'tfidf_v1', 4), ('s__toxic', 'emb_v1', 5)) as v(theme_id, model_version, k)
        where coalesce(speaker_role, '') <> 'interviewer'""",
    "model_runs": """select * from (values ('tfidf_v1', 's__quality', '2024-01-05T10:00', 30, 100, 0.61, 0.7, 0.65, 0.6, 0.5), ('tfidf_v2', 's__quality', '2024-02-05T10:00', 40, 120, 0.71, 0.72, 0.715, 0.7, 0.45),
        ('tfidf_v2', 's__toxic', '2024-02-05T10:00', 35, 90, 0.5, cast(null as double), cast(null as double), 0.4, 0.6), ('tfidf_v2', 's__mild', '2024-02-05T10:00', 27, 60, 0.4, 0.3, 0.34, 0.33, 0.55),
        ('emb_v1', 's__toxic', '2024-02-15T09:00', 160, 300, 0.8, 0.75, 0.77, 0.79, 0.5), ('emb_v0', 's__toxic', '2024-01-15T09:00', 150, 280, 0.7, 0.65, 0.67, 0.69, 0.5),
        ('tfidf_v0', 's__toxic', '2024-01-01T10:00', 20, 50, 0.3, 0.2, 0.24, 0.2, 0.5), ('odd_v1', 's__toxic', '2024-01-02T10:00', 20, 50, 0.3, 0.2, 0.24, 0.2, 0.5)) as t(model_version, theme_id, trained_at, n_pos, n_neg, prec, recall, f1, pr_auc, threshold)
        union all select case when o_custkey % 25 < 20 then 'tfidf_m' else 'emb_m' end || substr(cast(o_orderdate as string), 1, 7), 'n__' || cast(o_custkey % 25 as string), substr(cast(o_orderdate as string), 1, 7) || '-01T10:00', cast(count(*) as int), 100, round(cast(count(*) % 100 as double) / 100, 2), round(cast(max(o_custkey) % 100 as double) / 100, 2), 0.5,
          case when count(*) % 2 = 0 then 0.41 else 0.37 end, 0.5 from orders group by 1, 2, 3""",
    "run_params": """select * from (values ('tfidf_v2', '{"negative_mode": "reviewed", "codebook": {"version": "ab12"}}'), ('emb_v1', '{"codebook": {}}'), ('odd_v1', 'not json')) as t(model_version, params_json)
        union all select distinct 'tfidf_m' || substr(cast(o_orderdate as string), 1, 7), '{"negative_mode": "read_in_full", "codebook": {"version": "v' || substr(cast(o_orderdate as string), 1, 4) || '"}}' from orders""",
    "pins": """select * from (values ('tfidf_v0', 's__toxic')) as t(model_version, theme_id)
        union all select distinct 'tfidf_m' || substr(cast(o_orderdate as string), 1, 7), 'n__' || cast(o_custkey % 25 as string) from orders where substr(cast(o_orderdate as string), 6, 2) = '03' and o_custkey % 25 < 5""",
    "round_decisions": """select * from (values (1, '2024-01-12T00:00'), (2, '2024-02-10T00:00')) as t(decision_id, created_at)
        union all select distinct cast(substr(cast(o_orderdate as string), 1, 4) as int) - 3000, substr(cast(o_orderdate as string), 1, 4) || '-12-31T00:00' from orders""",
    "decisions": """select doc_id as decision_id, cast(doc_id as string) || ':0000' as segment_id, 's__quality' as theme_id, case doc_id % 3 when 0 then 'accept' when 1 then 'reject' else 'skip' end as decision,
        case when doc_id % 10 = 0 then '2024-03-05' end as undone_at, 'r' || cast(doc_id % 2 as string) as round_id from labels""",
    "activity": "select event_id as log_id, ts, 'user' || cast(user_id as string) as actor, event_type as action_type, props as details_json, value from events",
    "turns": """select cast(conv_id as string) as item_id, turn as turn_index, role as speaker_name, case role when 'user' then 'interviewer' when 'assistant' then 'subject' else 'other' end as speaker_role, text as content, conv_id from conversations""",
    "auto_duplicates": """select doc_id, cast(doc_id as string) as item_id, source as dataset_id, cast(doc_id - doc_id % 5 as string) as canonical_id, doc_id % 5 = 0 as is_canonical from documents where doc_id % 20 < 5""",
    "overrides": """select cast(doc_id as string) as item_id, source as dataset_id, case when doc_id % 2 = 0 then 'exclude' else 'include' end as kind, cast(doc_id - 1 as string) as target_id, doc_id from documents where doc_id % 37 = 3""",
    "segment_updates": """select segment_id, dataset_id, item_id, 'changed' as speaker_role, '2024-06-01' as created_at from segments where doc_id % 10 = 0 union all select concat('new:', segment_id), dataset_id, item_id, 'added', '2024-06-01' from segments where doc_id % 100 = 0""",
    "item_renames": "select dataset_id, item_id, 'renamed' as group_name, 'someone' as person_name from items where doc_id % 9 = 0",
    "override_updates": "select item_id, dataset_id, 'exclude' as kind, cast(null as string) as target_id from overrides where doc_id % 5 = 0",
    "schemes": """select * from (values ('s', 'Main scheme', 'all of it', 'active', '2024-01-01'), ('t', 'Other scheme', cast(null as string), 'active', '2024-01-01'), ('r', 'Places', 'where', 'active', '2024-01-01')) as t(scheme_id, name, description, status, created_at)
        union all select 'r' || cast(r_regionkey as string), r_name, 'one region', 'active', '2024-01-02' from region""",
    "duplicate_runs": """select * from (values ('dup_1', '2024-01-05'), ('dup_3', '2024-03-05'), ('dup_2', '2024-02-05')) as t(run_id, created_at)
        union all select distinct 'dup_' || substr(cast(o_orderdate as string), 1, 7), substr(cast(o_orderdate as string), 1, 7) || '-28' from orders""",
    "log": """select event_id as log_id, ts, 'user' || cast(user_id as string) as actor, case event_id % 9 when 0 then 'theme_create' when 1 then 'theme_update' when 2 then 'theme_merge' when 3 then 'training_run' when 4 then 'query_download' when 5 then 'iteration_decision' when 6 then 'scheme_archive' when 7 then 'metadata_edited' else event_type end as action_type,
        case event_id % 9 when 0 then '{"theme_id": "s__quality", "name": "Quality"}' when 1 then '{"theme_id": "s__toxic", "fields": {"name": "a", "color": "b"}}' when 2 then '{"source_theme_id": "s__mild", "target_theme_id": "s__toxic"}' when 3 then '{"model_version": "tfidf_v2", "trained": [{"name": "Quality"}, {"name": "Toxic"}]}'
          when 4 then '{"label": "Talks", "count": 7}' when 5 then '{"round_no": 2, "decision": "accept", "decision_label": "Accept the run", "run_ref": "tfidf_v2", "round_runs": ["tfidf_v2"], "note": "good"}' when 6 then '{"scheme_id": "s"}' when 7 then 'not json' else props end as details_json from events""",
    "topics": """select * from (values ('s__quality', 'Quality', 'seed', 'Text that reads well, unlike s__toxic or low_grade writing.', 'clear prose', 'see s__old_theme', '', 0), ('s__toxic', 'Toxic', 'seed', 'Abuse.', '', 'not s__quality', 'with_care', 1), ('other', 'Other', 'fixed', 'None of these.', '', '', '', 2),
        ('non_substantive', 'Small talk', 'fixed', 'Greetings.', '', '', '', 3)) as t(topic_id, name, origin, description, include, exclude, boundary_notes, position)
        union all select 'n_' || lower(replace(n_name, ' ', '_')), n_name, 'seed', 'Talk of ' || n_name || ', unlike s__old_theme.', n_name, case when n_nationkey % 5 = 0 then 'see no_such_topic' else '' end, '', 10 + n_nationkey from nation""",
    "coded_turns": """select cast(conv_id as string) || '_' || cast(10000 + turn as string) as comment_id, cast(conv_id as string) as interview_id, turn as turn_id, 'company' || cast(conv_id % 4 as string) as company, text as body, case (conv_id * 7 + turn) % 4 when 0 then 's__quality' when 1 then 's__toxic' when 2 then 'other' else 'non_substantive' end as primary_topic_id,
        case (conv_id + turn * 3) % 5 when 0 then 's__toxic' when 1 then 's__quality' else 'none' end as secondary_topic_id, round(cast((conv_id * 31 + turn * 17) % 101 as double) / 100, 2) as confidence, case when (conv_id * 7 + turn) % 4 = 3 then 'rule' else 'model' end as coded_by from conversations where role = 'assistant'""",
    "turn_gold": """select cast(conv_id as string) || '_' || cast(10000 + turn as string) as comment_id, theme_id, case (conv_id * 3 + turn + k) % 3 when 0 then 'pos' when 1 then 'neg' else 'neutral' end as gold, round(cast((conv_id * 13 + turn * 7 + k) % 100 as double) / 100, 2) as score, case when conv_id % 3 = 0 then 'read_in_full' when conv_id % 3 = 1 then 'positives_only' else '' end as gold_set, conv_id % 7 = 5 as eval_exclude
        from conversations cross join (values ('s__quality', 1), ('s__toxic', 2)) as v(theme_id, k) where role = 'assistant'""",
    "llm_usage": "select conv_id, turn, length(text) as input_tokens, case when turn % 2 = 0 then cast(null as int) else 40 end as output_tokens, case when turn = 0 then length(text) end as cache_creation_input_tokens, case when turn > 0 then 100 end as cache_read_input_tokens from conversations",
    "item_edits": "select dataset_id, item_id from items where doc_id % 2 = 1",
    "none_edits": "select segment_id, doc_id % 10 = 0 as withdrawn from segments where doc_id % 5 = 0",
    "label_edits": "select segment_id, 's__quality' as theme_id, 'coder0' as coder from segments where doc_id % 2 = 0",
    "undone_decisions": "select doc_id as decision_id, cast(doc_id as string) || ':0000' as segment_id from labels where doc_id % 4 = 0",
    "segment_turns": "select segment_id, cast(case when doc_id % 3 = 0 then 0 else doc_id % 2 end as bigint) as turn_index from segments where doc_id % 3 < 2",
    "own_negatives": """select negative_id, segment_id, theme_id, coder, created_at, deleted_at, doc_id from negatives union all select negative_id + 1000000000, segment_id, 's__mild', case when doc_id % 3 = 0 then 'coder0' else coder end, '2024-02-09', cast(null as string), doc_id from negatives where theme_id = 's__toxic' and doc_id % 4 <> 1""",
    "answers": """select comment_id, 0 as position, primary_topic_id, case when turn_id % 3 = 0 then primary_topic_id else secondary_topic_id end as secondary_topic_id, confidence * 1.5 - 0.2 as confidence from coded_turns where turn_id % 5 <> 1
        union all select comment_id, 1, 'other', 'none', 0.5 from coded_turns where turn_id % 2 = 1 union all select 'x' || comment_id, 0, 'other', 'none', 0.5 from coded_turns where turn_id = 3""",
    "sampled_turns": "select comment_id from coded_turns where turn_id % 3 <> 1",
    "dataset_status": "select distinct source as dataset_id, case source when 'src3' then 'excluded' else 'unloaded' end as status from documents where source in ('src3', 'src5')",
}


def _needed(sql: str) -> list[str]:
    """Canonical tables that ``sql`` names, each after those it needs."""
    out: list[str] = []
    for name, body in CANONICAL.items():
        if re.search(rf"\b(from|join|using)\s+\(?{name}\b", sql) or re.search(rf",\s*{name}\b\s*(,|$|where|\))", sql):
            for x in [*_needed(body), name]:
                if x not in out:
                    out.append(x)
    return out


def _with(sql: str, first: list[str]) -> str:
    parts = [*first, *(f"{n} as ({CANONICAL[n]})" for n in _needed(sql))]
    if not parts:
        return sql
    body = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql, flags=re.I)
    recursive = "recursive " if re.match(r"\s*with\s+recursive", sql, re.I) else ""
    return f"with {recursive}{', '.join(parts)}{',' if body != sql else ''} {body}"


def canonical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical or driver table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = CANONICAL[name]
    used = {n for t in [*_needed(body), name] for n in BASE if re.search(rf"\b{n}\b", CANONICAL[t])}
    first = [f"{n} as (select * from parquet.`{sf_dir}/{n}.parquet`)" for n in sorted(used)]
    return spark.sql(_with(f"select * from {name}", first))


def query(name: str, *tables: str, oracle: str | None = None):
    """Registers ``f(*DataFrames)`` as a query over the named tables, with its DuckDB SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(canonical(spark, sf_dir, t) for t in tables))
        if oracle:
            ORACLES[name] = _with(oracle, [])
        return f

    return register
