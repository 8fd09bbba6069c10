"""Queries of the problems tagged llm."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import hex_key, name_key, present, split_key, trimmed
from ..plans.core_problems import sql_hex, sql_name, sql_present
from ..plans.registry import Registry
from ..session import Scratch, load
from . import leakage, overlap, packing, percentiles, splits, subjects

R = Registry()

# ---- 2: the same or nearly the same records across splits

#: fixed values: the twelve entries of a semantic state
STATE_NAMES = ["live", "loads", "stores", "width", "unroll", "carry", "lanes", "regs", "align", "alias", "guard", "tail"]
STATE_DIFFER = 2


def _node_rows(spark: SparkSession, sf_dir: str, tmp: Scratch) -> DataFrame:
    return overlap.sided_rows(load(spark, sf_dir, "lazy_trace_nodes"), F.col("node_id"), split_key(F.col("split")), hex_key(F.col("semantic_state_hash"), 32),
                              overlap.state_entries(F.col("semantic_state"), STATE_NAMES), tmp, project=name_key(F.col("project")))


_SIDE = "CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('validation', 'valid', 'val', 'dev', 'test', 'testing', 'eval', 'evaluation') THEN 'held' END"
_ENTRY = "try_cast(json_extract_string(j, '$.{0}') AS DOUBLE) AS {0}"
_P2_SQL = f"""
    WITH raw AS (SELECT DISTINCT node_id, {_SIDE} AS side, {sql_hex('semantic_state_hash', 32)} AS h, CASE WHEN json_valid(semantic_state) THEN lower(semantic_state) END AS j FROM lazy_trace_nodes),
    s AS (SELECT node_id, side, h, j IS NOT NULL AS known, {', '.join(_ENTRY.format(n) for n in STATE_NAMES)} FROM raw WHERE side IS NOT NULL),
    pairs AS (SELECT a.node_id AS a, b.node_id AS b FROM s a JOIN s b ON a.side = 'held' AND b.side = 'train' AND a.node_id <> b.node_id
      AND (a.h = b.h OR (a.known AND b.known AND {' + '.join(f'(a.{n} IS DISTINCT FROM b.{n})::INTEGER' for n in STATE_NAMES)} <= {STATE_DIFFER}))),
    r AS (SELECT DISTINCT {sql_hex('root_id', 16)} AS k, root_id, {_SIDE} AS side FROM search_examples)
    SELECT DISTINCT 'node' AS record_kind, least(a, b) AS key_a, greatest(a, b) AS key_b FROM pairs
    UNION SELECT 'root', least(x.root_id, y.root_id), greatest(x.root_id, y.root_id) FROM r x JOIN r y ON x.k = y.k AND x.side = 'held' AND y.side = 'train'"""


_SPLIT = "CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('validation', 'valid', 'val', 'dev') THEN 'validation' WHEN lower(trim(split)) IN ('test', 'testing', 'eval', 'evaluation') THEN 'test' END"
_P2_REPORT_SQL = f"""
    WITH raw AS (SELECT DISTINCT node_id, {_SPLIT} AS split, {sql_name('project')} AS project, {sql_hex('semantic_state_hash', 32)} AS h, CASE WHEN json_valid(semantic_state) THEN lower(semantic_state) END AS j FROM lazy_trace_nodes),
    s AS (SELECT node_id, split, project, h, j IS NOT NULL AS known, {', '.join(_ENTRY.format(n) for n in STATE_NAMES)} FROM raw WHERE split IS NOT NULL AND node_id IS NOT NULL),
    met AS (SELECT a.node_id, a.split, a.project, max(CASE WHEN a.h = b.h THEN 1 WHEN a.known AND b.known AND {' AND '.join(f'a.{n} IS NOT DISTINCT FROM b.{n}' for n in STATE_NAMES)} THEN 1 ELSE 0 END) AS exact
      FROM s a JOIN s b ON a.split <> 'train' AND b.split = 'train'
      AND (a.h = b.h OR (a.known AND b.known AND {' + '.join(f'(a.{n} IS DISTINCT FROM b.{n})::INTEGER' for n in STATE_NAMES)} <= {STATE_DIFFER})) GROUP BY ALL),
    r AS (SELECT DISTINCT {sql_hex('root_id', 16)} AS k, {_SPLIT} AS split, {sql_name('project')} AS project, example_id, branch_id FROM search_examples)
    SELECT 'node' AS record_kind, split, project, count(*) AS records, CAST(sum(exact) AS BIGINT) AS exact FROM met GROUP BY split, project
    UNION ALL SELECT 'root', split, project, count(*), count(*) FROM r WHERE k IS NOT NULL AND split <> 'train' AND k IN (SELECT k FROM r WHERE k IS NOT NULL AND split = 'train') GROUP BY split, project"""


@R.add("p2_found", _P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark)
    rows = _node_rows(spark, sf_dir, tmp)
    _, pairs = overlap.overlap_classes(rows, len(STATE_NAMES), STATE_DIFFER, tmp)
    held = rows.where("side <> 'train'").select(F.col("cid").alias("c1"), F.col("rid").alias("a"))
    train = rows.where("side = 'train'").select(F.col("cid").alias("c2"), F.col("rid").alias("b"))
    near = pairs.join(held, pairs.held_cid == held.c1).join(train, pairs.train_cid == train.c2).select("a", "b")
    same = overlap.same_key_across(rows, F.col("rid"), F.unhex("digest"), F.col("side")).select(F.col("held_value").alias("a"), F.col("train_value").alias("b"))
    nodes = near.unionByName(same).where("a <> b").select(F.lit("node").alias("record_kind"), "a", "b")
    root = F.col("root_id")
    same = overlap.same_key_across(load(spark, sf_dir, "search_examples"), root, hex_key(root, 16), split_key(F.col("split")))
    roots = same.select(F.lit("root").alias("record_kind"), F.col("held_value").alias("a"), F.col("train_value").alias("b"))
    return nodes.unionByName(roots).select("record_kind", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


@R.add("p2_overlap_report", _P2_REPORT_SQL)
def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out records that recur in training, counted per kind, split and project; ``exact``: by hash or whole state.

    Equal hashes and equal states are found by membership, so no pair of copies is formed."""
    tmp = Scratch(spark)
    rows = _node_rows(spark, sf_dir, tmp)
    _, pairs = overlap.overlap_classes(rows, len(STATE_NAMES), STATE_DIFFER, tmp)
    best = pairs.groupBy(F.col("held_cid").alias("c")).agg(F.max((F.col("agree") == len(STATE_NAMES)).cast("int")).alias("whole"))
    digests = rows.where("side = 'train' and digest is not null").select(F.col("digest").alias("d")).distinct().withColumn("equal", F.lit(1))
    held = rows.where("side <> 'train'")
    flagged = held.join(best, held.cid == best.c, "left").join(digests, held.digest == digests.d, "left").where("whole is not null or equal is not null")
    exact = F.greatest(F.coalesce("whole", F.lit(0)), F.coalesce("equal", F.lit(0)))
    nodes = flagged.groupBy("rid", "side", "project").agg(F.max(exact).alias("exact"))
    nodes = nodes.groupBy(F.lit("node").alias("record_kind"), "side", "project").agg(F.count(F.lit(1)).alias("records"), F.sum("exact").alias("exact"))
    ex = load(spark, sf_dir, "search_examples").select(hex_key(F.col("root_id"), 16).alias("root"), split_key(F.col("split")).alias("side"), name_key(F.col("project")).alias("project"), "example_id", "branch_id").where("root is not null and side is not null")
    train = ex.where("side = 'train'").select(F.col("root").alias("tr")).distinct()
    roots = ex.where("side <> 'train'").join(train, F.col("root") == F.col("tr"), "left_semi").distinct()
    roots = roots.groupBy(F.lit("root").alias("record_kind"), "side", "project").agg(F.count(F.lit(1)).alias("records"), F.count(F.lit(1)).cast("bigint").alias("exact"))
    return nodes.unionByName(roots).withColumnRenamed("side", "split")


# ---- 3: percentiles

PERMILLE = [500, 900, 990, 999]
_SOURCES = (("profile_samples", "op", "captured_at", "microseconds", ("sample_id",)), ("search_examples", "project", "emitted_at", "proof_calls", ("example_id", "branch_id")))


def _once_sql() -> str:
    """Valid values, a record delivered again once and a row without a whole id for itself."""
    parts = []
    for table, grp, ts, value, ids in _SOURCES:
        own = f"CASE WHEN {' OR '.join(f'{i} IS NULL' for i in ids)} THEN row_number() OVER () END"
        parts.append(f"""SELECT source, grp, day, v FROM (SELECT DISTINCT '{table}' AS source, {', '.join(ids)}, {own} AS own, {sql_name(grp)} AS grp, CAST({ts} AS DATE) AS day, CAST({value} AS DOUBLE) AS v
            FROM {table} WHERE {value} IS NOT NULL AND NOT isnan(CAST({value} AS DOUBLE)) AND {value} >= 0 AND CAST({value} AS DOUBLE) < 'inf'::DOUBLE)""")
    return " UNION ALL ".join(parts)


def _percentile_sql() -> str:
    once = _once_sql()
    return f"""
    WITH once AS ({once}),
    twice AS (SELECT source, grp, day, v FROM once WHERE day IS NOT NULL UNION ALL SELECT source, grp, NULL, v FROM once),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source, grp, day ORDER BY v) AS r, count(*) OVER (PARTITION BY source, grp, day) AS n FROM twice)
    SELECT source, grp, day, n, {', '.join(f"max(CASE WHEN r = greatest(1, (n * {q} + 999) // 1000) THEN v END) AS p{q}" for q in PERMILLE)}, 0.0::DOUBLE AS max_error
    FROM placed GROUP BY source, grp, day, n"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp (struct of source and group), day, bits of both sources."""
    parts = []
    for table, grp, ts, value, ids in _SOURCES:
        rows = percentiles.records_once(load(spark, sf_dir, table), name_key(F.col(grp)), F.col(ts), F.col(value), [F.col(c) for c in ids])
        parts.append(rows.withColumn("grp", F.struct(F.lit(table).alias("source"), F.col("grp").alias("grp"))))
    return parts[0].unionByName(parts[1])


@R.add("p3_percentiles", _percentile_sql())
def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median, 90th, 99th and 99.9th percentile (nearest rank, so max_error 0) per group, by day and over all days (day NULL)."""
    rows = percentiles.percentiles_of(_values(spark, sf_dir), PERMILLE)
    wide = rows.groupBy("grp.source", "grp.grp", "day", "n")
    return wide.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{q}") for q in PERMILLE]).withColumn("max_error", F.lit(0.0))


_STATES_SQL = f"""once AS ({_once_sql()}), x AS (SELECT *, CASE WHEN v > 0 THEN floor(log2(v)) END AS e0 FROM once), y AS (SELECT *, CASE WHEN v < pow(2.0::DOUBLE, e0) THEN e0 - 1 WHEN v >= pow(2.0::DOUBLE, e0 + 1) THEN e0 + 1 ELSE e0 END AS e FROM x),
    s AS (SELECT source, grp, day, CASE WHEN v = 0 THEN 0 ELSE CAST((e + 1023) * 256 + floor((v / pow(2.0::DOUBLE, e) - 1) * 256) AS BIGINT) END AS digit, count(*) AS n FROM y GROUP BY ALL)"""
_LOW = "(1 + ({0}) % 256 / 256.0::DOUBLE) * pow(2.0::DOUBLE, ({0}) // 256 - 1023)"


@R.add("p3_daily_states", f"WITH {_STATES_SQL} SELECT source, grp, day, digit, n FROM s")
def p3_daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable states: per source, group and day the count of values by leading digit."""
    return percentiles.daily_states(_values(spark, sf_dir)).select("grp.source", "grp.grp", "day", "digit", "n")


@R.add("p3_from_states", f"""WITH {_STATES_SQL}, m AS (SELECT source, grp, digit, sum(n) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY source, grp) AS total FROM m WINDOW w AS (PARTITION BY source, grp ORDER BY digit)),
    q AS (SELECT *, unnest({PERMILLE}) AS q FROM r) SELECT source, grp, CAST(total AS BIGINT) AS n, q, CASE WHEN digit = 0 THEN 0 ELSE {_LOW.format('digit')} / 2 + {_LOW.format('digit + 1')} / 2 END AS value, pow(2.0::DOUBLE, -9) AS max_error FROM q
    WHERE upto >= greatest(1, (total * q + 999) // 1000) AND upto - n < greatest(1, (total * q + 999) // 1000)""")
def p3_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days read from the merged daily states alone, with the bound of their relative error (an
    error of at most 2^-1030 comes on top of it)."""
    states = p3_daily_states(spark, sf_dir).withColumn("grp", F.struct("source", "grp"))
    rows = percentiles.state_percentiles(percentiles.merged_states(states), PERMILLE)
    return rows.select("grp.source", "grp.grp", "n", "q", "value", F.lit(percentiles.STATE_ERROR).alias("max_error"))


# ---- 6: splits that keep related records together

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _split_keys() -> dict:
    return {"project": name_key(F.col("project")), "root": hex_key(F.col("root_id"), 16), "search": F.lower(trimmed(present(F.col("search_id"))))}


_P6_SQL = f"""
    WITH RECURSIVE rec AS (SELECT DISTINCT project AS written, 'p=' || {sql_name('project')} AS p, 'r=' || {sql_hex('root_id', 16)} AS r, 's=' || lower(trim({sql_present('search_id')})) AS s FROM search_examples),
    e AS (SELECT p AS a, r AS b FROM rec UNION SELECT p, s FROM rec UNION SELECT r, s FROM rec), u AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
    c AS (SELECT DISTINCT p AS start, p AS cur FROM rec WHERE p IS NOT NULL UNION SELECT c.start, u.b FROM c JOIN u ON c.cur = u.a), n AS (SELECT DISTINCT written, p FROM rec WHERE p IS NOT NULL)
    SELECT DISTINCT x.written AS project_a, y.written AS project_b FROM n x JOIN c ON c.start = x.p JOIN n y ON y.p = c.cur WHERE x.written < y.written"""


def _linked_projects(spark: SparkSession, sf_dir: str, tmp: Scratch) -> DataFrame:
    """project (as written), component: the smallest project of those that must stay together."""
    df = load(spark, sf_dir, "search_examples")
    component = splits.linked_values(df, _split_keys(), tmp)
    written = df.select("project", F.concat(F.lit("project="), name_key(F.col("project"))).alias("k")).where("k is not null").distinct()
    # a component's label is its smallest value, and names of projects come before those of roots and searches
    return written.join(component, written.k == component.v).select("project", F.substring("component", 9, 1 << 20).alias("component"))


@R.add("p6_members", _P6_SQL[:_P6_SQL.index("SELECT DISTINCT x.written")] + "SELECT n.written AS project, min(substr(c.cur, 3)) AS component FROM n JOIN c ON c.start = n.p WHERE c.cur LIKE 'p=%' GROUP BY n.written")
def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project name as written with the group it must stay in: one row a name, where p6_found lists pairs."""
    return _linked_projects(spark, sf_dir, Scratch(spark))


@R.add("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark)
    named = tmp.keep(_linked_projects(spark, sf_dir, tmp))
    a = named.select(F.col("project").alias("project_a"), F.col("component").alias("c"))
    b = named.select(F.col("project").alias("project_b"), "component")
    return a.join(b, (a.c == b.component) & (F.col("project_a") < F.col("project_b"))).select("project_a", "project_b").distinct()


@R.add("p6_split")
def p6_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_split(load(spark, sf_dir, "search_examples"), ["example_id", "branch_id"], _split_keys(), SHARES)


@R.add("p6_split_totals")
def p6_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p6_split(spark, sf_dir)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))


# ---- 7: filling containers

def tokenizer_path() -> str:
    """The vocabulary of the public tokenizer whose tokens are counted; PLEXAFORM_VOCABULARY names another ranks file."""
    return os.environ.get("PLEXAFORM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


#: fixed value: how that tokenizer splits a text before merging
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@R.add("p7_packing")
def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, position and unused tokens of every text, or piece of a text, for each context window."""
    windows = [(r["window_name"], r["capacity_tokens"], r["separator_tokens"]) for r in load(spark, sf_dir, "context_windows").collect()]
    counts = packing.token_counts(load(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), TOKEN_PATTERN)
    return packing.pack(counts, windows).withColumnRenamed("id", "doc_id")


@R.add("p7_utilisation")
def p7_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: containers used, the lower bound on them, texts cut, tokens and unused tokens."""
    rows = p7_packing(spark, sf_dir)
    windows = load(spark, sf_dir, "context_windows")
    per = rows.groupBy("window", "shard", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.max("unused").alias("unused"))
    out = per.groupBy("window").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.sum("unused").alias("unused"))
    w = windows.select(F.col("window_name"), "capacity_tokens", "separator_tokens")
    bound = F.ceil((F.col("tokens") + F.col("items") * F.col("separator_tokens")) / (F.col("capacity_tokens") + F.col("separator_tokens")))
    return out.join(F.broadcast(w), F.col("window") == F.col("window_name")).select("window", "containers", bound.alias("lower_bound"), "tokens", "items", "unused")


# ---- 8: evaluation texts in training text


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


@R.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@R.add("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items per source and suite: documents, distinct items and words held."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "source")
    suites = load(spark, sf_dir, "eval_items").select(F.col("item_id").alias("i"), "suite")
    found = _leaks(spark, sf_dir)
    rows = found.join(docs, found.doc_id == docs.d).join(suites, found.item_id == suites.i)
    return rows.groupBy("source", "suite").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"), F.sum("words").alias("words"))


@R.add("p8_clean_documents")
def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold no leaked item, with their texts."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return leakage.without_leaks(docs, "doc_id", _leaks(spark, sf_dir))


# ---- 9: subject areas


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = subjects.label_subjects(spark, docs, load(spark, sf_dir, "doc_labels"), load(spark, sf_dir, "subject_areas"), Scratch(spark))
    return subjects.score(docs, "doc_id", "text", model)


@R.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "subject").distinct()


@R.add("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents about it, their sentences about it, and the share of all such sentences."""
    rows = _scored(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))
    total = F.sum("sentences").over(Window.partitionBy())
    return rows.withColumn("share", F.round(F.col("sentences") / total, 6))
