"""Text and graph retrieval: chunking, ranking, label overlap, neighbourhoods, link rank, packing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens, identifiers, label_tokens, token_list, word_tokens
from tessera.plans.materialize import materialized

# The retrieval settings.
CHUNK_TOKENS, CHUNK_OVERLAP, TOP_CHUNKS = 200, 40, 5
SEEDS, DEPTH, GRAPH_BUDGET = 10, 2, 3_000
MAP_BUDGET, DUMP_BUDGET = 8_000, 80_000
DAMPING, ITERATIONS = 0.85, 30
K1, B, NEGATIVE_SHARE = 1.5, 0.75, 0.25
#: Bytes of a stated query set that is held as one array; a larger one is read in blocks.
QUERY_BYTES = 16 << 20


def chunks(docs: DataFrame, text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Token windows of ``size`` that overlap; the last is the first to reach the end. Empty texts have none."""
    step = max(1, size - overlap)
    tokens = docs.withColumn("_t", token_list(F.col(text))).where(F.size("_t") > 0)
    count = F.lit(1) + F.ceil(F.greatest(F.size("_t") - size, F.lit(0)) / step).cast("int")
    each = tokens.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    piece = F.slice("_t", F.col("chunk") * step + 1, F.lit(size))
    return each.withColumn("chunk_tokens", F.size(piece)).withColumn("chunk_text", F.array_join(piece, " ")).drop("_t")


def bm25(corpus: DataFrame, queries: DataFrame, key: str, query_key: str, text: str = "text", k: int = TOP_CHUNKS) -> DataFrame:
    """query_key, key, score, rank: the ``k`` best texts of each query; ties and zero scores by key.

    Okapi weights with k1 1.5 and b 0.75; a negative idf becomes a quarter of the mean idf. Query
    words count as often as they stand in the query. Only words of queries are joined and counted per text.
    """
    double = lambda x: F.lit(float(x))
    tokens = corpus.select(key, word_tokens(F.col(text)).alias("_w"))
    # One pass counts the texts of every word, and under no word all texts and their words.
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("_w"), F.array().cast("array<string>"))))
    counted = tokens.select(F.size("_w").alias("dl"), each.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("mean_dl"))
    counted = materialized(counted, "terms")
    shape = counted.where("term IS NULL")
    n, avgdl = shape.agg(F.coalesce(F.max("df"), F.lit(0)).cast("double")).scalar(), shape.agg(F.max("mean_dl")).scalar()
    idf = counted.where("term IS NOT NULL").select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw")).scalar()
    asked = queries.select(query_key, F.explode(word_tokens(F.col("text"))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    weights = asked.join(idf, "term").select(query_key, "term", "times", F.when(F.col("raw") < 0, mean * NEGATIVE_SHARE).otherwise(F.col("raw")).alias("idf"))
    held = (
        tokens.select(key, F.size("_w").alias("dl"), F.explode("_w").alias("term"))
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    part = F.col("times") * F.col("idf") * F.col("tf") * double(K1 + 1) / (F.col("tf") + double(K1) * (double(1 - B) + double(B) * F.col("dl") / avgdl))
    scored = held.join(weights, "term").groupBy(query_key, key).agg(F.sum(part).alias("score"))
    # Texts without a query word score 0 and may fill the list: the k smallest keys are enough.
    lowest = corpus.select(key).orderBy(key).limit(k).agg(F.collect_list(key)).scalar()
    filling = queries.select(query_key, F.explode(lowest).alias(key)).withColumn("score", F.lit(0.0))
    both = scored.unionByName(filling).groupBy(query_key, key).agg(F.sum("score").alias("score"))
    # Sums differ in their last digits with the order of rows, which must not break ties.
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def vocabulary(nodes: DataFrame, key: str = "id", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """node_tokens (key, token) and vocabulary (token, df, idf = ln(N / df)); an empty label is its id."""
    named = nodes.select(key, F.coalesce(F.nullif(F.col(label), F.lit("")), F.col(key).cast("string")).alias("_l"))
    held = named.select(key, F.explode(label_tokens(F.col("_l"))).alias("token"))
    n = nodes.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")).scalar()
    return held, held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(n / F.col("df")))


def seeds(nodes: DataFrame, question: Column, key: str = "id", label: str = "label", k: int = SEEDS) -> DataFrame:
    """The ``k`` nodes whose labels share the heaviest tokens with the question; none if it shares no token."""
    held, words = vocabulary(nodes, key, label)
    asked = nodes.sparkSession.range(1).select(F.explode(label_tokens(question)).alias("token"))
    weights = words.join(F.broadcast(asked), "token").select("token", "idf")  # at most the question's tokens
    scored = held.join(F.broadcast(weights), "token").groupBy(key).agg(F.sum("idf").alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def undirected(links: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """source, target both ways, once each, of links whose ends are both nodes."""
    ids = nodes.select(key)
    inner = links.select("source", "target").join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return inner.select("source", "target").union(inner.select("target", "source")).toDF("source", "target").distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = DEPTH) -> DataFrame:
    """node and its least number of steps from ``start`` (column node), up to ``depth``."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def pack(lines: DataFrame, cost: str, order: Sequence[str], budget: int, by: Sequence[str] = ()) -> DataFrame:
    """The leading lines whose running cost stays within the budget; the first overflow ends it.

    A line costs at least 1, so no more than ``budget`` of them can matter.
    """
    place = Window.partitionBy(*by).orderBy(*order)
    near = lines.orderBy(*order).limit(budget) if not by else lines.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= budget).drop("_n")
    used = F.sum(F.greatest(F.col(cost), F.lit(1))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used", used).where(F.col("used") <= budget)


def link_rank(edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, every: int = 5, nodes: DataFrame | None = None) -> DataFrame:
    """node, rank after a fixed number of steps; the weight of nodes without a way out is lost.

    ``edges`` (source, target) are distinct; ``nodes`` (node) may add some without any. Without nodes there are no
    rows. Lineage is cut every few steps.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = materialized(edges.select("source", "target"), "edges")
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    linked = edges.select("source").union(edges.select("target")).toDF("node")
    nodes = materialized((linked.union(nodes.select("node")) if nodes is not None else linked).distinct(), "nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    if not n:
        return rank
    # Both stay dealt by the key that each step joins on, so that a step moves nothing but ranks.
    weighted = edges.join(out, "source").select("source", "target", (1 / F.col("degree")).alias("weight")).repartition(parts, "source").persist(StorageLevel.DISK_ONLY)
    dealt = nodes.repartition(parts, "node").persist(StorageLevel.DISK_ONLY)
    for step in range(1, iterations + 1):
        given = weighted.join(rank.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("weight") * F.col("rank")).alias("given"))
        rank = dealt.join(given, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if step % every == 0:
            rank = materialized(rank, "rank")
    weighted.unpersist()
    dealt.unpersist()
    return rank


def reference_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target: files that mention a name which another file defines. ``references``: file, text; ``symbols``: file, name."""
    defined = symbols.select(F.substring_index("name", ".", 1).alias("ident"), F.col("file").alias("target")).distinct()
    used = references.select(F.col("file").alias("source"), F.explode(identifiers(F.col("text"))).alias("ident")).distinct()
    return used.join(defined, "ident").where("source <> target").select("source", "target").distinct()


def symbol_map(references: DataFrame, symbols: DataFrame, budget: int = MAP_BUDGET, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """The lines of a repository map in order: symbols (file, name, signature, summary) by their file's
    link rank, a header before each file, packed to the budget. A header's cost counts before the check.
    Every file that defines or mentions something has a rank, links or not."""
    files = references.select("file").union(symbols.select("file")).where("file IS NOT NULL").distinct().toDF("node")
    ranks = link_rank(reference_edges(references, symbols), nodes=files)
    line = F.concat(F.lit("  "), F.col("signature"), F.when(F.col("summary") != "", F.concat(F.lit("  — "), F.col("summary"))).otherwise(F.lit("")), F.lit("\n"))
    ordered = symbols.join(ranks.toDF("file", "rank"), "file", "left").select("file", "name", line.alias("line"), F.coalesce("rank", F.lit(0.0)).alias("rank"))
    place = Window.orderBy(F.desc("rank"), "file", "name")
    near = ordered.orderBy(F.desc("rank"), "file", "name").limit(budget)
    fresh = F.coalesce(F.lag("file").over(place) != F.col("file"), F.lit(True))
    headed = near.withColumn("text", F.concat(F.when(fresh, F.concat(F.lit("\n# file: "), F.col("file"), F.lit("\n"))).otherwise(F.lit("")), F.col("line")))
    placed = headed.withColumn("place", F.row_number().over(place))
    return placed.withColumn("used", F.sum(counter(F.col("text"))).over(place.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def chunk_build_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cost of an index of chunks: the tokens of all of them."""
    return chunks(docs, text).agg(F.coalesce(F.sum("chunk_tokens"), F.lit(0)).cast("bigint").alias("build_tokens"))


def head_of_dump(docs: DataFrame, by: Sequence[str], order: Sequence[str], text: str = "text", budget: int = DUMP_BUDGET) -> DataFrame:
    """Which texts of a dump, joined in order, lie within its first ``budget`` tokens and how many of each's."""
    counted = docs.select(*by, *order, count_tokens(F.col(text)).cast("bigint").alias("tokens")).where("tokens > 0")
    place = Window.partitionBy(*by).orderBy(*order)
    near = counted.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= budget).drop("_n")
    before = F.sum("tokens").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return near.withColumn("before", before).where(F.col("before") < budget).select(*by, *order, "tokens", F.least(F.col("tokens"), F.lit(budget) - F.col("before")).alias("kept_tokens"))


def containing(docs: DataFrame, needles: DataFrame, key: str, needle_key: str) -> DataFrame:
    """Pairs of a text and a needle that it holds in any case. The needles are a stated query set, read in blocks.

    A word inside a needle, with other characters on both sides, is a whole word of every text that holds it: a text is
    compared with the needles whose longest such word it has, and with the few that have none.
    """
    total = needles.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_BYTES))
    word = r"[\p{L}\p{N}_]+"
    words = lambda c: F.regexp_extract_all(c, F.lit(word), F.lit(0))
    low = needles.select(needle_key, F.lower("text").alias("t"))
    inner = words(F.regexp_replace("t", rf"^{word}|{word}$", " "))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    low = low.withColumn("probe", longest)
    out = None
    for block in range(blocks):
        part = low.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block) if blocks > 1 else low
        probes = F.coalesce(part.where("probe IS NOT NULL").agg(F.collect_set("probe")).scalar(), F.array().cast("array<string>"))
        text = docs.select(key, F.lower("text").alias("_t"))
        near = text.withColumn("probe", F.explode(F.array_intersect(words(F.col("_t")), probes))).join(F.broadcast(part), "probe")  # a block is at most QUERY_BYTES
        bare = part.where("probe IS NULL AND t IS NOT NULL").agg(F.collect_list(F.struct(F.col(needle_key), "t"))).scalar()
        rest = text.withColumn("_q", F.explode(bare)).select(key, "_t", F.col(f"_q.{needle_key}").alias(needle_key), F.col("_q.t").alias("t"))
        found = near.select(key, "_t", needle_key, "t").unionByName(rest).where(F.contains("_t", F.col("t"))).select(key, needle_key)
        out = found if out is None else out.unionByName(found)
    return out


def graph_context(nodes: DataFrame, links: DataFrame, question: Column, key: str = "id", budget: int = GRAPH_BUDGET) -> DataFrame:
    """The packed lines of the nodes near the question's seeds, by steps and node."""
    start = seeds(nodes, question, key).select(F.col(key).alias("node"))
    near = neighbourhood(undirected(links, nodes, key), start)
    lines = near.join(nodes.withColumnRenamed(key, "node"), "node").withColumn("line", render_node()).withColumn("cost", count_tokens(F.col("line")))
    return pack(lines, "cost", ["depth", "node"], budget)


def render_node() -> Column:
    at = F.coalesce(F.col("source_location").cast("string"), F.lit(""))
    return F.concat(F.lit("- "), F.col("label"), F.lit("  ("), F.coalesce("source_file", F.lit("?")), F.when(at == "", "").otherwise(":"), at, F.lit(")\n"))


def graph_build_tokens(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Cost of the whole graph: a line for each node and each link."""
    a = nodes.agg(F.sum(count_tokens(render_node())).alias("t"))
    b = links.agg(F.sum(count_tokens(F.concat(F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit("--"), F.coalesce("relation", F.lit("")), F.lit("->"), F.coalesce(F.col("target").cast("string"), F.lit(""))))).alias("t"))
    return a.unionByName(b).agg(F.sum("t").alias("build_tokens"))


