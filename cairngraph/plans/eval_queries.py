"""Queries of the read ledger, grading, coverage, grounding and batch reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.text import code_blocks, collapse, identifiers, task_of_run, task_pattern, typographic
from ..operators import build, evaluate, ledger
from ..operators.spread import parsed, parts
from .common import GRAPH, NODES, Graph

_FN = "CASE event_type WHEN 'view' THEN 'edges' WHEN 'click' THEN 'name' WHEN 'signup' THEN 'has' WHEN 'purchase' THEN 'descriptions' ELSE 'rank' END"


def _log(g: Graph):
    """Events as calls: run = user; every third edges call is unfiltered in both directions, every fifth call finds nothing."""
    e = g.table("events")
    k = F.get_json_object("props", "$.k").cast("long")
    item = F.concat(F.lit("Q"), (k + 30000000).cast("string"))
    seq = F.col("event_id")  # event ids rise with time
    args = F.array(item, F.when(F.col("event_id") % 3 == 0, "both").otherwise("out"), F.lit(""))
    ids = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(item))
    return e.select(F.col("user_id").alias("run"), seq.alias("seq"), F.expr(_FN).alias("fn"), args.alias("args"), ids.alias("ids"))


def read_ledger(spark, sf_dir):
    return ledger.charges(_log(Graph(spark, sf_dir))).select("run", "seq", "fn", "charged", "spent")


def read_budget(spark, sf_dir):
    charged = ledger.charges(_log(Graph(spark, sf_dir)))
    return ledger.exhausted(charged, 40).join(ledger.reads_left(charged, 60), "run", "full_outer")


def seen_ids(spark, sf_dir):
    return ledger.seen_ids(_log(Graph(spark, sf_dir))).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


def ungrounded_ids(spark, sf_dir):
    """Each run answers with 20 ids around its own number; the question names one of them."""
    g = Graph(spark, sf_dir)
    runs = g.table("events").select(F.col("user_id").alias("run")).distinct()
    item = lambda c: F.concat(F.lit("Q"), (c + 30000000).cast("string"))
    answers = runs.select("run", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: item((F.col("run") + i) % 100)).alias("ids"), F.array(item(F.col("run") % 100)).alias("question_ids"))
    return ledger.ungrounded(answers, _log(g))


def coverage_widest(spark, sf_dir):
    """Runs are users; each event obtains some suppliers of one order."""
    g = Graph(spark, sf_dir)
    e = g.table("events").select(F.col("user_id").alias("run"), (F.get_json_object("props", "$.k").cast("long") + 40000000).alias("anchor"), "event_id")
    # slices of the anchors that are read, whole
    read = e.select(F.col("anchor").alias("src")).distinct().hint("shuffle_hash")
    out = build.build_edges(g.raw_edges.where("prop = 6").join(read, "src", "left_semi"), g.nodes, parts(g.raw_edges.where("prop = 6"))).select(F.col("src").alias("anchor"), F.col("dst").alias("id"))
    reads = e.join(out, "anchor").where((F.col("event_id") + F.col("id")) % 2 == 0).select("run", "anchor", F.lit("out").alias("direction"), F.lit(6).alias("prop"), "id")
    sizes = out.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).select("anchor", F.lit("out").alias("direction"), F.lit(6).alias("prop"), "size")
    return evaluate.coverage(reads, sizes, parts(g.table("events"), 128 << 10))


def grounding_verdict(spark, sf_dir):
    """Whole documents quoted: some altered, some attributed to nothing, some never read."""
    docs = Graph(spark, sf_dir).table("documents")
    text = F.col("text")
    quotes = docs.select(F.col("doc_id").alias("quote"), F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id")).alias("entity"), F.lit("en").alias("language"), F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("text"))
    stored = docs.select(F.col("doc_id").alias("entity"), F.col("lang").alias("language"), "text")
    reads = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("entity"), F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("language"))
    return evaluate.grounding(quotes, stored, reads).select("quote", "verdict")


def passage_containment(spark, sf_dir):
    """Longest benchmark passage that each document quotes word for word, typography folded on both sides.

    Passages meet documents by their first eight words, not by a cross product; the full text decides.
    """
    g = Graph(spark, sf_dir)
    plain = lambda c: collapse(typographic(F.col(c)))
    items = g.table("benchmark").select("item_id", plain("text").alias("passage")).withColumn("words", F.split("passage", " ")).where("size(words) >= 8")
    keyed = items.select("item_id", "passage", F.array_join(F.slice("words", 1, 8), " ").alias("key"))
    docs = g.table("documents").select("doc_id", plain("text").alias("body")).withColumn("words", F.split("body", " ")).where("size(words) >= 8")
    grams = docs.select("doc_id", "body", F.explode(F.expr("array_distinct(transform(sequence(0, size(words) - 8), i -> array_join(slice(words, i + 1, 8), ' ')))")).alias("key"))
    # passages are a fixed benchmark; Spark broadcasts their keys only if they are small enough
    met = grams.join(keyed, "key", "inner").where(F.contains("body", F.col("passage")))
    return met.groupBy("doc_id").agg(F.max_by("item_id", F.struct(F.length("passage"), -F.col("item_id"))).alias("item_id"), F.countDistinct("item_id").alias("passages"))


def grade_keyed(spark, sf_dir):
    """Labels as answers: quality expected, toxic got; a task is a hundred documents, some rows are missing, repeated or without id."""
    l = Graph(spark, sf_dir).table("labels").withColumn("task", F.floor(F.col("doc_id") / 100))
    expected = l.where("doc_id % 11 <> 0").select("task", F.col("doc_id").alias("qid"), F.col("quality").alias("value"))
    got = l.where("doc_id % 7 <> 0").select("task", F.when(F.col("doc_id") % 13 != 0, F.col("doc_id")).alias("qid"), F.col("toxic").alias("value"), F.lit(1).alias("place"))
    again = l.where("doc_id % 10 = 3 and doc_id % 7 <> 0").select("task", F.col("doc_id").alias("qid"), (1 - F.col("toxic")).alias("value"), F.lit(2).alias("place"))
    return evaluate.grade_keyed(expected, got.union(again), "qid", ["value"])


def overlap_f1(spark, sf_dir):
    """Brands of small parts against brands of cheap parts, as multisets per size class."""
    p = Graph(spark, sf_dir).table("part").withColumn("task", F.col("p_size") % 10)
    return evaluate.overlap(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), "p_brand")


def row_identities(spark, sf_dir):
    """Order lines per order: the line number identifies them unless it repeats; then the part may."""
    l = Graph(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("item"))
    return evaluate.row_identity(l)


def graded_answers(spark, sf_dir):
    """Customer answers with a list, a nested object, a fact and a count: one key is wrong in each way in turn, and each sixth doesn't parse."""
    c = parsed(Graph(spark, sf_dir).table("customer").select("c_custkey"), "c_custkey")
    n, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    rows = lambda last: F.concat(F.lit('{"rows": [{"qid": "Q1", "n": 1}, {"qid": "'), last, F.lit('", "n": 2}], "who": {"name": "a", "born": null}, "total": '))
    want = F.concat(rows(F.lit("Q2")), n, F.lit(', "examined": 5}'))
    fact = F.when(kind == 2, F.lit("-1")).otherwise(n)
    odd = F.concat(F.lit('{"rows": [{"n": 2, "qid": "q2"}, {"qid": "Q1", "n": 1}, {"qid": "Q1"}, {"qid": "Q7"}], "who": {"name": "a"}, "total": '), fact, F.lit("}"))
    same = F.concat(F.lit('{"rows": [{"n": 2, "qid": "q2"}, {"qid": "Q1", "n": 1}], "who": {"name": "a"}, "total": '), fact, F.when(kind == 3, F.lit(', "examined": 9}')).when(kind == 4, F.lit(', "extra": 1, "examined": 5}')).otherwise(F.lit(', "examined": 5}')))
    got = F.when(kind == 0, F.lit("no json")).when(kind == 1, F.concat(F.regexp_replace(odd, r"\}$", ""), F.lit(', "examined": 5}'))).otherwise(same)
    return c.select("c_custkey", canonical.graded(want, got, ("examined",)).alias("g")).select("c_custkey", "g.*")


def seen_text_languages(spark, sf_dir):
    """Events as calls that show texts: how many entities each run saw in each language."""
    log = _log(Graph(spark, sf_dir)).drop("fn", "args")
    e = Graph(spark, sf_dir).table("events").select(F.col("event_id").alias("seq"), F.expr("CASE event_type WHEN 'purchase' THEN 'descriptions' WHEN 'signup' THEN 'description' WHEN 'click' THEN 'entity' ELSE 'edges' END").alias("fn"))
    calls = log.join(e, "seq").withColumn("args", F.when(F.col("seq") % 2 == 0, F.array(F.lit("x"), F.lit("fr"))).otherwise(F.array(F.lit("x"))))
    return evaluate.seen_text(calls).groupBy("run", "language").agg(F.count(F.lit(1)).alias("n"))


def exact_canonical(spark, sf_dir):
    """Customer answers written two ways: other key order, curly quotes, lower-case ids, floats; every fourth differs, and every sixth says an id twice."""
    c = parsed(Graph(spark, sf_dir).table("customer").select("c_custkey", "c_name"), "c_custkey")
    n = F.col("c_custkey").cast("string")
    want = F.concat(F.lit('{"name": "it\'s '), F.col("c_name"), F.lit('", "ids": ["Q1", "Q'), n, F.lit('"], "n": '), n, F.lit("}"))
    got = F.concat(F.lit('{"n": '), n, F.lit('.0, "ids": ["q'), n, F.when(F.col("c_custkey") % 6 == 5, F.lit('", "q1", "q1"], "name": "it’s  ')).otherwise(F.lit('", "q1"], "name": "it’s  ')), F.when(F.col("c_custkey") % 4 == 0, F.lit("no")).otherwise(F.col("c_name")), F.lit('"}'))
    return c.select("c_custkey", canonical.exact(want, got).alias("exact"))


def gold_audit(spark, sf_dir):
    """Gold rows of customers with planted faults, against nodes and segment texts in English."""
    g = Graph(spark, sf_dir)
    c, k = g.table("customer"), F.col("c_custkey")
    rows = c.select(
        F.lit("t").alias("task"), F.when(k % 10 != 1, F.when(k % 10 == 2, k + 90000000).otherwise(k + 10000000)).alias("qid"), F.when(k % 10 == 3, "wrong").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 10 == 4, "never stored").when(k % 2 == 0, F.col("c_mktsegment")).alias("evidence"), F.when(k % 10 == 5, "fr").when(k % 10 == 6, None).otherwise("en").alias("language"), F.lit(3).alias("listed"), F.when(k % 10 == 7, 4).otherwise(3).alias("counted"),
    )
    stored = c.select((k + 10000000).alias("entity"), F.lit("en").alias("language"), F.col("c_mktsegment").alias("text"))
    return evaluate.gold_audit(rows, g.nodes, stored)


def _runs(g: Graph):
    """Orders as scored runs of tasks (customers); later orders are later runs."""
    o = g.table("orders")
    return o.select(
        F.concat(F.element_at(F.array(*map(F.lit, ("LT", "ST", "SST", "PST"))), (F.col("o_custkey") % 4 + 1).cast("int")), F.lit("_"), F.col("o_custkey").cast("string")).alias("task"), F.col("o_orderkey").alias("place"), (F.col("o_orderstatus") == "F").alias("exact"), (F.col("o_orderstatus") != "O").alias("content_exact"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "final").when(F.col("o_orderpriority") == "5-LOW", "max_iters").otherwise("interrupted").alias("status"), (F.col("o_orderkey") % 9).alias("turns"), (F.col("o_orderkey") % 50).alias("reads"), (F.col("o_orderkey") * 10).alias("tokens"),
        (F.col("o_totalprice") / 1000).alias("wall"), (F.col("o_orderkey") % 5).alias("calls"), (F.col("o_orderkey") % 1000).alias("reasoning_tokens"), F.lit(600).alias("output_tokens"),
    )


def compare_batches(spark, sf_dir):
    """The last runs of even orders against those of odd orders."""
    r = _runs(Graph(spark, sf_dir))
    return evaluate.compare(evaluate.last_runs(r.where("place % 2 = 0"), "place"), evaluate.last_runs(r.where("place % 2 = 1"), "place"))


def summary_by_pattern(spark, sf_dir):
    return evaluate.summary(_runs(Graph(spark, sf_dir)), task_pattern(F.col("task")))


def summary_overall(spark, sf_dir):
    return evaluate.summary(_runs(Graph(spark, sf_dir)))


def timing_stats(spark, sf_dir):
    return evaluate.timing(_runs(Graph(spark, sf_dir)), "status")


def thinking_share(spark, sf_dir):
    return evaluate.thinking(_runs(Graph(spark, sf_dir)).withColumn("family", F.col("task").substr(1, 2)), "family")


def task_audit(spark, sf_dir):
    g = Graph(spark, sf_dir)
    runs = _runs(g)
    names = F.concat(F.element_at(F.array(*map(F.lit, ("LT", "ST", "SST", "PST"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("_"), F.col("c_custkey").cast("string"))
    tasks = g.table("customer").select(names.alias("task"), F.col("c_mktsegment").alias("family"), (F.col("c_acctbal") > 0).alias("valid"))
    return evaluate.task_audit(tasks, runs.select("task", "place", "exact"))


def turn_pairing(spark, sf_dir):
    out = evaluate.turn_pairs(Graph(spark, sf_dir).table("conversations"))
    return out.select("conv_id", "number", F.md5("reply").alias("reply"), F.md5("observation").alias("observation"))


def identifier_extract(spark, sf_dir):
    """Ids in made-up answers: beside punctuation, inside words, and repeated."""
    c = Graph(spark, sf_dir).table("customer")
    n = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("(Q"), n, F.lit("), P31; geneQ5 Q7x xP3 Q"), n, F.lit(" end"))
    return c.select("c_custkey", F.array_join(identifiers(text), ",").alias("ids"))


def code_cells(spark, sf_dir):
    """Fenced blocks of made-up replies: with a language, without, and of another language."""
    c = Graph(spark, sf_dir).table("customer")
    n = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("plan\n```python\na = "), n, F.lit("\n```\nthen\n```\nb = 2\n```\n```json\n{}\n```"))
    return c.select("c_custkey", F.array_join(code_blocks(text), "|").alias("blocks"))


def run_names(spark, sf_dir):
    o = Graph(spark, sf_dir).table("orders")
    run = F.concat(F.lit("LT_TASK_"), F.col("o_custkey").cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_120000_"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", task_of_run(run).alias("task"), task_pattern(run).alias("pattern"))


QUERIES = {f.__name__: f for f in (
    read_ledger, read_budget, seen_ids, ungrounded_ids, coverage_widest, grounding_verdict, passage_containment, grade_keyed, overlap_f1, row_identities, exact_canonical, graded_answers, seen_text_languages, gold_audit, compare_batches,
    summary_by_pattern, summary_overall, timing_stats, thinking_share, task_audit, turn_pairing, identifier_extract, code_cells, run_names,
)}

_LOG = """l AS (SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'view' THEN 'edges' WHEN 'click' THEN 'name' WHEN 'signup' THEN 'has' WHEN 'purchase' THEN 'descriptions' ELSE 'rank' END AS fn,
    30000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, event_id % 3 = 0 AS both_ways, event_id % 5 <> 0 AS hit FROM events)"""
_CHARGED = f"""{_LOG}, f AS (SELECT *, min(CASE WHEN hit THEN seq END) OVER (PARTITION BY run, item) AS first_hit, min(CASE WHEN fn = 'edges' AND both_ways THEN seq END) OVER (PARTITION BY run, item) AS first_full FROM l),
  k AS (SELECT run, seq, fn, CASE WHEN fn IN ('has', 'name', 'rank') AND NOT (hit AND first_hit = seq) THEN 0 WHEN fn = 'edges' AND coalesce(first_full < seq, false) THEN 0 ELSE 1 END AS charged FROM f),
  c AS (SELECT *, sum(charged) OVER (PARTITION BY run ORDER BY seq)::BIGINT AS spent FROM k)"""
_RUNS = """r AS (SELECT concat(CASE o_custkey % 4 WHEN 0 THEN 'LT' WHEN 1 THEN 'ST' WHEN 2 THEN 'SST' ELSE 'PST' END, '_', o_custkey) AS task, o_orderkey AS place, o_orderstatus = 'F' AS exact, o_orderstatus <> 'O' AS content_exact,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'final' WHEN '5-LOW' THEN 'max_iters' ELSE 'interrupted' END AS status, o_orderkey % 9 AS turns, o_orderkey % 50 AS reads, o_orderkey * 10 AS tokens, o_totalprice / 1000 AS wall, o_orderkey % 5 AS calls, o_orderkey % 1000 AS reasoning FROM orders)"""
_SUMMARY = "count(*) AS tasks, count(*) FILTER (exact) AS exact, count(*) FILTER (content_exact) AS content_exact, count(*) FILTER (status = 'final') AS reached_final, count(*) FILTER (status = 'max_iters') AS max_iters, sum(turns)::BIGINT AS turns, sum(reads)::BIGINT AS reads, sum(tokens)::BIGINT AS tokens"
_F1 = "CASE WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / (2.0 * tp + fp + fn), 4) END AS f1"
ORACLES = {
    "read_ledger": f"WITH {_CHARGED} SELECT run, seq, fn, charged, spent FROM c",
    "read_budget": f'WITH {_CHARGED}, x AS (SELECT run, min(seq) AS seq FROM c WHERE spent > 40 GROUP BY 1), y AS (SELECT run, greatest(0, 60 - max(spent)) AS "left" FROM c GROUP BY 1) SELECT run, seq, "left" FROM y LEFT JOIN x USING (run)',
    "seen_ids": f"WITH {_LOG} SELECT run, count(DISTINCT item) AS n, concat('Q', min(item)) AS least FROM l WHERE hit GROUP BY 1",
    "ungrounded_ids": f"""WITH {_LOG}, a AS (SELECT DISTINCT run, 30000000 + (run + i) % 100 AS item FROM l, range(1, 20) t(i))
        SELECT run, concat('Q', item) AS id FROM a WHERE item <> 30000000 + run % 100 AND (run, item) NOT IN (SELECT run, item FROM l WHERE hit)""",
    "coverage_widest": f"""WITH {GRAPH}, o AS (SELECT src AS anchor, dst AS id FROM edges WHERE prop = 6), z AS (SELECT anchor, count(*) AS size FROM o GROUP BY 1),
        e AS (SELECT user_id AS run, 40000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS anchor, event_id FROM events),
        g AS (SELECT run, anchor, count(DISTINCT id) AS obtained FROM e JOIN o USING (anchor) WHERE (event_id + id) % 2 = 0 GROUP BY 1, 2),
        w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY size DESC, obtained DESC, anchor) AS n FROM g JOIN z USING (anchor))
        SELECT run, anchor, 'out' AS direction, 6 AS prop, obtained, size, round(obtained / size, 4) AS share FROM w WHERE n = 1""",
    "grounding_verdict": r"""WITH d AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS t FROM documents),
        q AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS entity, CASE WHEN doc_id % 5 = 0 THEN concat(t, '!') ELSE t END AS t FROM d),
        r AS (SELECT doc_id AS entity, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS lang FROM documents WHERE doc_id % 3 <> 0)
        SELECT q.doc_id AS quote, CASE WHEN q.entity IS NULL THEN 'UNCHECKED' WHEN d.t <> q.t THEN 'NOT_VERBATIM' WHEN (q.entity, d.lang) IN (SELECT entity, lang FROM r) THEN 'GROUNDED' ELSE 'BLIND' END AS verdict FROM q LEFT JOIN d ON d.doc_id = q.entity""",
    "passage_containment": f"""WITH b AS (SELECT item_id, {'{0}'} AS passage FROM benchmark), d AS (SELECT doc_id, {'{0}'} AS body FROM documents),
        m AS (SELECT doc_id, item_id, length(passage) AS n FROM d JOIN b ON contains(body, passage) WHERE len(string_split(passage, ' ')) >= 8)
        SELECT doc_id, first(item_id ORDER BY n DESC, item_id) AS item_id, count(DISTINCT item_id) AS passages FROM m GROUP BY 1""".replace("{0}", r"trim(regexp_replace(translate(text, '’‘ʼ“”„–—−', '''''''\"\"\"---'), '\s+', ' ', 'g'))".replace('\\"', '"')),
    "grade_keyed": f"""WITH l AS (SELECT *, doc_id // 100 AS task FROM labels), e AS (SELECT task, doc_id AS qid, quality AS value FROM l WHERE doc_id % 11 <> 0), g0 AS (SELECT task, CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS qid, toxic AS value FROM l WHERE doc_id % 7 <> 0),
        rep AS (SELECT task, doc_id AS qid FROM l WHERE doc_id % 10 = 3 AND doc_id % 7 <> 0),
        first_got AS (SELECT task, qid, value FROM g0 WHERE qid IS NOT NULL UNION ALL SELECT l.task, l.doc_id, 1 - l.toxic FROM l JOIN rep ON rep.qid = l.doc_id WHERE l.doc_id % 13 = 0),
        rows AS (SELECT task, count(*) AS n FROM (SELECT task FROM g0 UNION ALL SELECT task FROM rep) GROUP BY 1), j AS (SELECT coalesce(e.task, g.task) AS task, e.qid AS a, g.qid AS b, e.value = g.value AS same FROM e FULL JOIN first_got g ON e.task = g.task AND e.qid = g.qid),
        s AS (SELECT task, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (b IS NULL) AS fn, count(b) AS kept, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (same) AS details_ok FROM j GROUP BY 1),
        t AS (SELECT s.*, extra + coalesce(n, 0) - kept AS fp FROM s LEFT JOIN rows USING (task))
        SELECT task, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 4) END AS recall, {_F1}, details_ok FROM t""",
    "overlap_f1": f"""WITH a AS (SELECT p_size % 10 AS task, p_brand, count(*) AS a FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT p_size % 10 AS task, p_brand, count(*) AS b FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
        s AS (SELECT task, sum(least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS tp, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS fn FROM a FULL JOIN b USING (task, p_brand) GROUP BY 1) SELECT *, {_F1} FROM s""",
    "row_identities": "SELECT l_orderkey AS task, CASE WHEN count(DISTINCT l_linenumber) = count(*) THEN 'id' WHEN count(DISTINCT l_partkey) = count(*) THEN 'item' END AS identity FROM lineitem GROUP BY 1",
    "exact_canonical": "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 6 <> 5 AS exact FROM customer",
    "graded_answers": """SELECT c_custkey, CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN 0.6667 ELSE 1.0 END AS DOUBLE) AS set_f1, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 IN (2, 3) THEN '2/3' ELSE '3/3' END AS scalars_ok,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 6 IN (3, 5) END AS content_exact FROM customer""",
    "seen_text_languages": """WITH c AS (SELECT user_id AS run, concat('Q', CAST(json_extract_string(props, '$.k') AS BIGINT) + 30000000) AS entity, event_type AS t, event_id AS i FROM events WHERE event_id % 5 <> 0),
        x AS (SELECT run, entity, unnest(CASE WHEN t = 'purchase' OR t = 'signup' AND i % 2 = 1 THEN ['en', 'fr', 'de', 'zh', 'ar', 'ru'] WHEN t = 'signup' THEN ['fr'] WHEN t = 'click' THEN ['en'] ELSE [] END) AS language FROM c)
        SELECT run, language, count(DISTINCT entity) AS n FROM x GROUP BY 1, 2""",
    "gold_audit": """WITH c AS (SELECT c_custkey % 10 AS k, c_custkey % 2 AS odd, count(*) AS n FROM customer GROUP BY 1, 2),
        x AS (SELECT 'qid_absent' AS "check", n FROM c WHERE k = 1 UNION ALL SELECT 'not_in_graph', n FROM c WHERE k = 2 UNION ALL SELECT 'name_vs_label_en', n FROM c WHERE k = 3
          UNION ALL SELECT 'evidence_not_stored', n FROM c WHERE k = 4 UNION ALL SELECT 'evidence_lang_absent', n FROM c WHERE k = 6 UNION ALL SELECT 'lang_not_available', n FROM c WHERE k = 5 UNION ALL SELECT 'count_mismatch', n FROM c WHERE k = 7)
        SELECT "check", sum(n)::BIGINT AS n FROM x GROUP BY 1""",
    "compare_batches": f"""WITH {_RUNS}, a AS (SELECT task, max_by(exact, place) AS a FROM r WHERE place % 2 = 0 GROUP BY 1), b AS (SELECT task, max_by(exact, place) AS b FROM r WHERE place % 2 = 1 GROUP BY 1)
        SELECT count(*) FILTER (NOT a AND b) AS fixed, count(*) FILTER (a AND NOT b) AS broken, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (b IS NULL) AS only_before, count(*) FILTER (a IS NULL) AS only_after, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared FROM a FULL JOIN b USING (task)""",
    "summary_by_pattern": f"WITH {_RUNS} SELECT split_part(task, '_', 1) AS pattern, {_SUMMARY} FROM r GROUP BY 1",
    "summary_overall": f"WITH {_RUNS} SELECT {_SUMMARY} FROM r",
    "timing_stats": f"WITH {_RUNS} SELECT status, count(*) AS runs, round(sum(wall), 2) AS total, round(median(wall), 2) AS median, round(max(wall), 2) AS longest, round(sum(wall) / sum(calls), 2) AS per_call, round(sum(tokens) / sum(wall), 2) AS tokens_per_second FROM r GROUP BY 1",
    "thinking_share": f"WITH {_RUNS} SELECT substr(task, 1, 2) AS family, count(*) AS runs, round(sum(reasoning) / (count(*) * 600.0), 4) AS share, sum(reasoning) / (count(*) * 600.0) > 1 AS impossible FROM r GROUP BY 1",
    "task_audit": f"""WITH {_RUNS}, z AS (SELECT task, max_by(exact, place) AS exact FROM r GROUP BY 1), t AS (SELECT concat(CASE c_custkey % 4 WHEN 0 THEN 'LT' WHEN 1 THEN 'ST' WHEN 2 THEN 'SST' ELSE 'PST' END, '_', c_custkey) AS task, c_mktsegment AS family, c_acctbal > 0 AS valid FROM customer)
        SELECT family, count(*) AS tasks, count(*) FILTER (valid) AS valid, count(z.task) AS run, count(*) FILTER (z.exact) AS exact FROM t LEFT JOIN z USING (task) GROUP BY 1""",
    "turn_pairing": """WITH m AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, (sum((role = 'assistant')::INT) OVER w)::BIGINT AS number FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, number, md5(text) AS reply, md5(CASE WHEN next_role = 'user' THEN next_text END) AS observation FROM m WHERE role = 'assistant'""",
    "identifier_extract": "SELECT c_custkey, concat('Q', c_custkey, ',P31,Q', c_custkey) AS ids FROM customer",
    "code_cells": "SELECT c_custkey, concat('a = ', c_custkey, chr(10), '|b = 2', chr(10)) AS blocks FROM customer",
    "run_names": "SELECT o_orderkey, concat('LT_TASK_', o_custkey) AS task, 'LT' AS pattern FROM orders",
}
