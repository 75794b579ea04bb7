"""The knowledge graph as vertex and edge tables: extraction, upserts, traversal, matching, communities.

Edges are (subject, object, relation, weight, sources). Sequences that decide (first spelling, first type,
first relation) are columns, never the order of rows. Traversals join a frontier with the edges, one join
a step, and keep the nodes seen so far apart; the number of steps is bounded by the caller's depth.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.checkpoint import checkpointed
from .components import connected_components
from .search import doubles

#: Nodes of a type that are compared at a time.
SIMILAR_BLOCK = 1024
#: Names of a type that are merged in the first round.
FIRST_NAMES = 256

# ---------------------------------------------------------------- fixed values

STOPWORDS = (
    "The This That These Those There Here It Its In Is Are Was Were Be Been For And But Or Nor Not No So A AN THE AND OR FOR IS TO OF BY AT ON AS IF DO UP WE MY HE ME US AM AN IF GO VS "
    "ALL HAS HAD GET GOT DID MAY CAN LET USE SET HOW WHO WHY NEW OLD ONE TWO KEY SEE MAX MIN TOP END ALSO MANY EACH BOTH SUCH SOME MORE MOST VERY WELL MUCH THAN THEN WHEN WITH FROM HAVE "
    "WILL BEEN INTO ONLY OVER JUST ALSO LIKE WHAT MAKE TAKE USED HELP MAKE DOES WIDE TYPE BEST HIGH LOOK ARGS NOTE TODO NONE TRUE LAST MUST SAME LONG NEXT NEED"
).split()
SENTENCE_STARTERS = "These Those This That There Their They Some Many Most Each Every Several Both One Two Three Four Five Other Another Common Various Popular Important".split()
CAMEL = r"\b[A-Z][a-z]+(?:[A-Z][a-zA-Z]+)+\b"
ACRONYM = r"\b[A-Z][A-Z0-9]{1,9}\b"
PHRASE = r"\b[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,}){1,2}\b"
EXPANSION = r"([A-Z][a-z]+(?:[\s\-]+[A-Za-z]+){1,5})\s+\(([A-Z][A-Z0-9]{1,9})\)"
EXPANSION_AFTER = r"([A-Z][A-Z0-9]{1,9})\s+\(([A-Z][a-z]+(?:[\s\-]+[a-z]+){1,5})\)"
TRAILING_ADVERBS = "natively typically commonly generally usually effectively essentially primarily mainly also".split()
VERB_STARTS = "are is was were has have had can could will would should may might do does did being been".split()
TRAILING_JUNK = r"(?i)\s+(?:with|of|for|in|to|from|by|at|on|and|or|that|which|where|through)$"
#: Relation and pattern, in the order of trial; the first ends a sentence.
RELATIONS = [
    ("subset_of", r"(\b[A-Z][A-Za-z\s\-]{2,30}?)\s+is\s+a\s+subset\s+of\s+(\b[a-z][a-z\s\-]{2,40})\b"),
    ("is_a", r"(\b[A-Z][A-Za-z\s\-]{2,30}?)\s+is\s+an?\s+(\b[a-z][a-z\s\-]{2,50})\b"),
    ("used_for", r"(\b[A-Z][A-Za-z\s\-]{2,30}?)\s+(?:is|are)\s+(?:widely\s+)?used\s+(?:in|for)\s+(\b[a-z][a-z\s\-,]{2,50})\b"),
    ("uses", r"(\b[A-Z][A-Za-z\s\-]{2,30}?)\s+(?:includes?|uses?|supports?|combines?|provides?|enables?)\s+(\b[a-z][a-z\s\-]{2,50})\b"),
]
SUCH_AS = r"(\b[a-z][a-z\s\-]{2,30}?)\s+such\s+as\s+([A-Z][\w\s,\-]{2,80})"

# ---------------------------------------------------------------- extraction


def without_headings(c: Column) -> Column:
    return F.regexp_replace(c, r"(?dmU)^#{1,6}\s+.*$", "")


def entities(c: Column) -> Column:
    """The distinct entity names of a text."""
    plain = without_headings(c)
    every = lambda p: F.regexp_extract_all(plain, F.lit("(?U)" + p), F.lit(0))
    acronyms = F.filter(every(ACRONYM), lambda x: ~x.isin(STOPWORDS))
    first = lambda x: F.regexp_extract(x, r"^\S+", 0)
    stops = F.array(*[F.lit(s) for s in sorted(set(STOPWORDS))])
    phrases = F.filter(every(PHRASE), lambda x: ~first(x).isin(SENTENCE_STARTERS) & ~F.arrays_overlap(F.split(x, " "), stops))
    return F.array_distinct(F.concat(every(CAMEL), acronyms, phrases))


def entity_type(name: Column) -> Column:
    return F.when(name.rlike(r"^[A-Z][a-z]+[A-Z]"), "technology").when(name.rlike(r"^[A-Z][A-Z0-9]+$"), "acronym").otherwise("concept")


def aliases(c: Column) -> Column:
    """A map from acronym to long form; a later match, and the second form of writing, wins."""
    all_of = lambda p, short, long: F.arrays_zip(F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(short)).alias("k"), F.transform(F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(long)), T.strip).alias("v"))
    pairs = F.concat(all_of(EXPANSION, 2, 1), all_of(EXPANSION_AFTER, 1, 2))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(T.words(c), 1, n), " ")


def relations(docs: DataFrame, key: str, text: str = "text", clean: bool = False) -> DataFrame:
    """(key, subject, relation, object) of each sentence's patterns.

    is_a and uses need a subject that overlaps a known entity of the text. clean drops fragments:
    long parts, leading articles, trailing adverbs and prepositions, verbs first, short words.
    """
    # in the select that explodes, the entities of the whole text would be looked for again with each sentence
    known = docs.select(key, entities(F.col(text)).alias("known"), F.split(without_headings(F.col(text)), r"(?U)[.!?\n]\s*").alias("s"))
    rows = known.select(key, "known", F.explode("s").alias("s")).filter(F.length(T.strip(F.col("s"))) >= 10)
    s = F.col("s")
    found = lambda p, g: T.strip(F.regexp_extract(s, "(?U)" + p, g))
    triple = lambda subject, relation, obj, asked: F.struct(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), F.lit(asked).alias("asked"))
    none = F.array().cast("array<struct<subject:string,relation:string,object:string,asked:boolean>>")
    parts = []
    subset = s.rlike("(?U)" + RELATIONS[0][1])
    for name, pattern in RELATIONS:
        subject, obj = found(pattern, 1), found(pattern, 2)
        holds = s.rlike("(?U)" + pattern)
        if name != "subset_of":
            holds, obj = holds & ~subset, first_words(obj, 4)
        parts.append(F.when(holds, F.array(triple(subject, name, obj, name in ("is_a", "uses")))).otherwise(none))
    category, listed = found(SUCH_AS, 1), F.regexp_replace(found(SUCH_AS, 2), r"[., ]+$", "")
    examples = F.filter(F.transform(F.split(listed, r"(?U),\s*(?:and\s+)?"), T.strip), lambda e: e.rlike(r"^\p{Lu}") & (F.size(T.words(e)) <= 4))
    such = T.let(category, lambda c: F.transform(examples, lambda e: triple(e, "is_a", c, False)))
    parts.append(F.when(~subset & s.rlike("(?U)" + SUCH_AS), such).otherwise(none))
    # the known names are gone through with a subject that was taken out of its sentence before
    out = rows.select(key, "known", F.inline(F.concat(*parts)))
    overlaps = F.exists("known", lambda e: F.contains(e, F.col("subject")) | F.contains(F.col("subject"), e))
    out = out.filter(~F.col("asked") | overlaps).select(key, "subject", "relation", "object")
    return clean_relations(out) if clean else out


def clean_relations(rows: DataFrame) -> DataFrame:
    words = lambda c: T.words(F.col(c))
    rows = rows.filter((F.size(words("subject")) <= 4) & (F.size(words("object")) <= 4))
    first = lambda c: F.lower(F.get(words(c), 0))
    rows = rows.filter(~F.coalesce(first("subject").isin("the", "a", "an"), F.lit(False)) & ~F.coalesce(F.lower(F.try_element_at(words("subject"), F.lit(-1))).isin(TRAILING_ADVERBS), F.lit(False)))
    rows = rows.filter(~F.coalesce(first("object").isin(VERB_STARTS), F.lit(False)))
    rows = rows.withColumn("object", T.strip(F.regexp_replace("object", TRAILING_JUNK, ""))).filter(F.length("object") >= 3)
    return rows.filter(~((F.size(words("object")) == 1) & F.col("object").rlike(r"^\p{Ll}") & (F.length("object") < 5)))


# ---------------------------------------------------------------- names and upserts


def canonical_names(mentions: DataFrame, name: str = "name", seq: str = "seq", alias: DataFrame | None = None) -> DataFrame:
    """mentions with `canonical`: the alias's target, then the spelling that was seen first."""
    rows = mentions
    if alias is not None:
        rows = rows.join(alias.select(F.col("alias").alias(name), F.col("target").alias("target_")), name, "left").withColumn("resolved_", F.coalesce("target_", name)).drop("target_")
    else:
        rows = rows.withColumn("resolved_", F.col(name))
    first = rows.groupBy(F.lower("resolved_").alias("fold_")).agg(F.min(F.struct(seq, "resolved_")).alias("f_"))
    first = first.select("fold_", F.col("f_.resolved_").alias("canonical"))
    return rows.withColumn("fold_", F.lower("resolved_")).join(first, "fold_").drop("fold_", "resolved_")


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """mentions (canonical, type, source, seq): count, sorted sources, and the type of the first mention."""
    return mentions.groupBy("canonical").agg(F.count("*").alias("mention_count"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("seq", "type"))["type"].alias("type"))


def upsert_edges(triples: DataFrame, semantics: str = "digraph") -> DataFrame:
    """triples (subject, object, relation, source, weight, seq), no self-edges.

    digraph: one edge a pair, with the first relation and the weight of all; multigraph: one a relation.
    """
    rows = triples.filter("subject <> object")
    keys = ["subject", "object"] if semantics == "digraph" else ["subject", "object", "relation"]
    measures = [F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source")).alias("sources")]
    if semantics == "digraph":
        measures.append(F.min(F.struct("seq", "relation"))["relation"].alias("relation"))
    return rows.groupBy(*keys).agg(*measures)


def remove_source(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without the source, those it alone had gone; edges that had it are gone."""
    left = nodes.withColumn("sources", F.array_remove("sources", source)).filter((F.size("sources") > 0) | ~F.array_contains(nodes["sources"], source))
    return left, edges.filter(~F.array_contains("sources", source))


def merge_entities(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges (loser, winner): counts added, sources united, edges redirected and added up."""
    to = lambda df, c: df.join(merges.select(F.col("loser").alias(c), F.col("winner").alias("w_")), c, "left").withColumn(c, F.coalesce("w_", c)).drop("w_")
    merged = to(nodes, "canonical").groupBy("canonical").agg(F.sum("mention_count").alias("mention_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    moved = to(to(edges, "subject"), "object").filter("subject <> object")
    return merged, moved.groupBy("subject", "object").agg(F.sum("weight").alias("weight"))


def final_winners(merges: DataFrame) -> DataFrame:
    """merges (loser, winner) with each winner's own winner in its place, until none has one."""
    while True:
        step = checkpointed(merges.join(merges.select(F.col("loser").alias("winner"), F.col("winner").alias("next_")), "winner", "left"))
        if step.filter("next_ is not null").isEmpty():
            return merges
        merges = step.select("loser", F.coalesce("next_", "winner").alias("winner"))


def resolve(nodes: DataFrame, edges: DataFrame, alias: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after the merges by aliases (alias, target), then by similar vectors of what is left; and the merges by phase.

    vectors: (name, type, place, vector). Names that aren't among the nodes merge into none.
    """
    here = nodes.select(F.col("canonical").alias("n_"))
    by_alias = alias.join(here, F.col("alias") == F.col("n_"), "left_semi").join(here, F.col("target") == F.col("n_"), "left_semi")
    by_alias = final_winners(checkpointed(by_alias.groupBy(F.col("alias").alias("loser")).agg(F.min("target").alias("winner")).filter("loser <> winner")))
    nodes, edges = (checkpointed(t) for t in merge_entities(nodes, edges, by_alias))
    left = vectors.join(nodes.select(F.col("canonical").alias("name")), "name", "left_semi")
    by_vector = similar_merges(left, nodes.select("canonical", "mention_count"), threshold)
    nodes, edges = merge_entities(nodes, edges, final_winners(by_vector))
    merges = by_alias.select("loser", "winner").withColumn("phase", F.lit("alias")).unionByName(by_vector.withColumn("phase", F.lit("embedding")))
    return nodes, edges, merges


# ---------------------------------------------------------------- traversal


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("subject", "object").union(edges.select("object", "subject")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, directed: bool = True, relations: list[str] | None = None) -> DataFrame:
    """(seed, node, distance) of the nodes at most `depth` steps from each seed, without the seed itself; without a depth until nothing is new.

    Seeds with the same direct neighbours reach the same nodes at the same distances, but for themselves: such a class is
    walked once. A class's nodes meet its seeds at the end, so rows of seeds and nodes are neither shuffled nor made distinct.
    """
    if relations is not None:
        edges = edges.filter(F.col("relation").isin(relations))
    steps = (edges.select("subject", "object").distinct() if directed else both_directions(edges)).toDF("at_", "to_")
    if depth is None or depth > 1:  # every step reads them
        steps = checkpointed(steps, "steps")
    first = seeds.select("seed").distinct().join(steps, F.col("seed") == F.col("at_")).select("seed", F.col("to_").alias("node"))
    if depth == 1:
        return first.filter("seed <> node").withColumn("distance", F.lit(1))
    hashed = F.xxhash64("node")
    named = first.groupBy("seed").agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("total"), F.bit_xor(hashed).alias("parity"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("second"))
    named, same = checkpointed(named, "named"), ["n", "total", "parity", "second"]
    named = checkpointed(named.join(named.groupBy(same).agg(F.min("seed").alias("class_")), same).select("seed", "class_"), "classes")
    of_class = first.join(named.filter("seed = class_").select("seed"), "seed", "left_semi")
    seen = frontier = checkpointed(of_class.select(F.col("seed").alias("class_"), "node", F.lit(1).alias("distance")), "frontier")
    for d in itertools.count(2) if depth is None else range(2, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("at_")).select("class_", F.col("to_").alias("node")).distinct()
        frontier = reached.join(seen.select("class_", "node"), ["class_", "node"], "left_anti").withColumn("distance", F.lit(d))
        if d != depth:  # the next step reads it twice
            frontier = checkpointed(frontier, "frontier")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * edges.sparkSession.sparkContext.defaultParallelism)
    spread = seen.repartition(tasks, "class_", "node")  # a few rows here are many with their seeds
    return spread.join(named, "class_").filter("seed <> node").select("seed", "node", "distance")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, semantics: str = "digraph") -> DataFrame:
    """digraph: out-edges to the depth and direct predecessors; multigraph: any direction to the depth."""
    if semantics == "multigraph":
        return reachable(edges, seeds, depth, directed=False).select("seed", "node")
    before = seeds.join(edges, F.col("seed") == F.col("object")).select("seed", F.col("subject").alias("node"))
    return reachable(edges, seeds, depth).select("seed", "node").union(before).filter("seed <> node").distinct()


def typed_neighbours(edges: DataFrame, seeds: DataFrame, depth: int, relations: list[str], semantics: str = "digraph") -> DataFrame:
    """digraph: both directions mixed; multigraph: only outgoing paths, and only incoming ones."""
    if not relations or depth < 1:
        raise ValueError("relations and a depth of one or more are needed")
    if semantics == "digraph":
        return reachable(edges, seeds, depth, False, relations).select("seed", "node")
    back = edges.select(F.col("object").alias("subject"), F.col("subject").alias("object"), "relation")
    return reachable(edges, seeds, depth, True, relations).select("seed", "node").union(reachable(back, seeds, depth, True, relations).select("seed", "node")).distinct()


def match_paths(edges: DataFrame, seeds: DataFrame, pattern: list[str], fan_out: int = 50) -> DataFrame:
    """(seed, terminal, label) of paths whose steps have the pattern's relations, in either direction, without cycles.

    Of each seed's frontier the first `fan_out` in the order of names go on, as the operator defines.
    """
    paths = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("visited"))
    for relation in pattern:
        hop = edges.filter(F.col("relation") == relation)
        hop = hop.select(F.col("subject").alias("at_"), F.col("object").alias("to_")).union(hop.select("object", "subject")).distinct()
        paths = paths.join(hop, F.col("node") == F.col("at_")).filter(~F.array_contains("visited", F.col("to_")))
        paths = paths.select("seed", F.col("to_").alias("node"), F.array_append("visited", F.col("to_")).alias("visited"))
        place = F.row_number().over(Window.partitionBy("seed").orderBy("node", "visited"))
        paths = paths.withColumn("place_", place).filter(F.col("place_") <= fan_out).drop("place_")
    return paths.select("seed", F.col("node").alias("terminal"), F.lit(" > ".join(pattern)).alias("label")).distinct()


def expand_query(matched: DataFrame, edges: DataFrame, queries: DataFrame, cap: int = 3) -> DataFrame:
    """(query_id, term, rank): neighbours of the matched entities that the query doesn't hold, heaviest first."""
    near = edges.select(F.col("subject").alias("name"), F.col("object").alias("term"), "weight").unionByName(edges.select(F.col("object").alias("name"), F.col("subject").alias("term"), "weight"))
    terms = matched.join(near, "name").groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    fresh = terms.join(queries, "query_id").filter(~F.contains(F.lower("text"), F.lower("term")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))
    return fresh.select("query_id", "term", rank.alias("rank")).filter(F.col("rank") <= cap)


def match_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name) of the entities whose names a query holds between word borders.

    An equi-join on the name's tokens instead of a nested loop: a query's runs of as many tokens as
    any name has are looked up among the names.
    """
    tokens = lambda c: T.words(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))
    named = names.select("name", tokens("name").alias("words_")).filter(F.size("words_") > 0).select("name", F.array_join("words_", " ").alias("key"), F.size("words_").alias("n_words"))
    lengths = F.broadcast(named.agg(F.collect_set("n_words").alias("lengths_")))  # one row
    run = lambda w, i: F.transform(F.filter("lengths_", lambda k: k <= F.size(w) - i), lambda k: F.array_join(F.slice(w, i + 1, k), " "))
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: run(w, i)))
    spans = queries.select("query_id", "text").crossJoin(lengths).select("query_id", T.let(tokens("text"), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<string>"))).alias("runs"))
    return spans.select("query_id", F.explode(F.array_distinct("runs")).alias("key")).join(named.select("name", "key"), "key").select("query_id", "name").distinct()


# ---------------------------------------------------------------- resolution and communities


def similar_names(nodes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(type, a, b, similarity) of nodes (name, type, place, vector) of one type whose vectors are close; a stands first.

    Exact: a type's nodes are dealt into blocks by a hash, and every two blocks are compared as matrices in
    one task; only close pairs become rows. A zero vector is close to none.
    """
    rows = nodes.select("type", "name", F.col("place").cast("long").alias("place"), doubles(F.col("vector")).alias("vector")).filter("vector is not null")
    sizes = rows.groupBy("type").agg(F.ceil(F.count("*") / SIMILAR_BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "type").withColumn("block", F.pmod(F.xxhash64("name", "place"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("type", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "name", "place", "vector")

    def compare(table):
        import pyarrow as pa

        table = table.sort_by([("place", "ascending"), ("name", "ascending")])
        block, place = table.column("block").to_numpy(), table.column("place").to_numpy()
        v = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
        v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
        close = v @ v.T
        wanted = (close >= threshold) & (place[:, None] < place)
        if block.min() < block.max():
            wanted &= block[:, None] != block
        i, j = np.nonzero(wanted)
        names = table.column("name")
        return pa.table({"type": table.column("type").take(pa.array(i)), "a": names.take(pa.array(i)), "b": names.take(pa.array(j)), "similarity": pa.array(close[i, j])})

    return dealt.groupBy("type", "low", "high").applyInArrow(compare, "type string, a string, b string, similarity double")


def greedy_merges(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(loser, winner) of the pairs taken in order, a merged name taking part no more. The higher count wins, the earlier on a tie.

    The choice is sequential only among names that pairs connect, so each such component is a task's group.
    """
    key = lambda c: F.concat_ws("\0", "type", c)
    parts = connected_components(pairs.select(key("a").alias("a"), key("b").alias("b")))
    pairs = pairs.withColumn("node", key("a")).join(parts, "node").drop("node")
    c = counts.select(F.col("canonical"), "mention_count")
    rows = pairs.join(c.toDF("a", "na"), "a").join(c.toDF("b", "nb"), "b")
    return _taken_in_order(rows, "component").select("loser", "winner")


def _taken_in_order(rows: DataFrame, *parts: str) -> DataFrame:
    """(type, loser, winner) of pairs (type, *parts, a, b, na, nb), those of a type and its parts by a and b in one task."""
    keys = ["type", *parts]

    def choose(batches):
        import pyarrow as pa

        at, gone = None, set()
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb"))
            for *group, a, b, na, nb in zip(*(batch.column(k).to_pylist() for k in keys), *columns, strict=True):
                if group != at:
                    at, gone = group, set()
                if a in gone or b in gone:
                    continue
                winner, loser = (b, a) if nb > na else (a, b)
                gone.add(loser)
                out.append((group[0], loser, winner))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], ["type", "loser", "winner"])

    # pairs pass a task in order, sorted by Spark: of a group, Python holds the merged names alone
    dealt = rows.select(*keys, "a", "b", "na", "nb").repartition(*keys).sortWithinPartitions(*keys, "a", "b")
    return dealt.mapInArrow(choose, "type string, loser string, winner string")


def similar_merges(nodes: DataFrame, counts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(loser, winner): the greedy merges of the similar names, without making all pairs.

    Exact: a pair counts only if neither name is merged when its turn comes. So the names that stand first are taken in
    rounds, FIRST_NAMES of a type and four times as many each round; they meet the names still there, and those merged
    take no part in later rounds. Pairs of a type are one task's in a round, since the choice is sequential.
    """
    c = counts.select(F.col("canonical").alias("name"), F.col("mention_count").cast("long").alias("n"))
    rows = nodes.select("type", "name", F.col("place").cast("long").alias("place"), "vector").filter("vector is not null and type is not null")
    left = checkpointed(rows.join(c, "name").withColumn("waits", F.lit(True)), "left")
    merges, size = [], FIRST_NAMES
    while not left.filter("waits").isEmpty():
        rank = F.dense_rank().over(Window.partitionBy("type").orderBy("name"))
        first = left.filter("waits").select("type", "name").withColumn("rank", rank).filter(F.col("rank") <= size)
        ends = checkpointed(first.groupBy("type").agg(F.max("name").alias("end"), F.ceil(F.max("rank") / SIMILAR_BLOCK).cast("int").alias("parts")), "ends")
        merges.append(checkpointed(_taken_in_order(_close_pairs(left, ends, threshold)), "merges"))
        still = left.join(merges[-1].select("type", F.col("loser").alias("name")), ["type", "name"], "left_anti").join(ends, "type", "left")
        left = checkpointed(still.withColumn("waits", F.coalesce(F.col("waits") & (F.col("name") > F.col("end")), F.lit(False))).drop("end", "parts"), "left")
        size *= 4
    if not merges:
        return nodes.sparkSession.createDataFrame([], "loser string, winner string")
    return functools.reduce(DataFrame.unionByName, merges).select("loser", "winner")


def _close_pairs(left: DataFrame, ends: DataFrame, threshold: float) -> DataFrame:
    """(type, a, b, na, nb) of the close pairs of left (type, name, place, vector, n, waits): a waits and is no later name than its type's end in ends (type, end, parts); a stands first.

    The a of a type are dealt into parts, all its rows into blocks, and each part is compared with each block as matrices in a task.
    """
    sizes = left.groupBy("type").agg(F.ceil(F.count("*") / (4 * SIMILAR_BLOCK)).cast("int").alias("blocks")).join(ends, "type")
    rows = left.withColumn("vector", doubles(F.col("vector"))).join(sizes, "type")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("name", "place"), F.col(c)).cast("int")
    columns = ["type", "block", "part", "asks", "name", "place", "vector", "n"]
    asks = rows.filter("waits and name <= end").withColumn("part", dealt("parts")).withColumn("block", upto("blocks")).withColumn("asks", F.lit(True))
    asked = rows.withColumn("block", dealt("blocks")).withColumn("part", upto("parts")).withColumn("asks", F.lit(False))

    def compare(table):
        import pyarrow as pa

        asks, place = table.column("asks").to_numpy(), table.column("place").to_numpy()
        v = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(place), -1)
        v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
        at, other = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        i, j = np.nonzero((v[at] @ v[other].T >= threshold) & (place[at][:, None] < place[other]))
        take = lambda c, k: table.column(c).take(pa.array(k))
        i, j = at[i], other[j]
        return pa.table({"type": take("type", i), "a": take("name", i), "b": take("name", j), "na": take("n", i), "nb": take("n", j)})

    return asks.select(columns).unionByName(asked.select(columns)).groupBy("type", "block", "part").applyInArrow(compare, "type string, a string, b string, na long, nb long")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation: each round a node takes the heaviest label around it, the smallest on a tie.

    Nodes start with their own names; a fixed number of rounds keeps the plan and the result deterministic.
    """
    both = edges.select("subject", "object", "weight").union(edges.select("object", "subject", "weight")).groupBy("subject", "object").agg(F.max("weight").alias("weight")).toDF("node", "other", "weight")
    # its own label counts as much as its heaviest edge, so that two nodes can't go on swapping theirs
    labels = both.groupBy("node").agg(F.max("weight").alias("own_")).withColumn("community", F.col("node"))
    both = checkpointed(both)
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("other"), F.col("community").alias("label")), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        own = labels.select("node", F.col("community").alias("label"), F.col("own_").cast("double").alias("w"))
        votes = votes.select("node", "label", F.col("w").cast("double").alias("w")).unionByName(own).groupBy("node", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct(-F.col("w"), "label"))["label"].alias("community"))
        labels = labels.drop("community").join(best, "node")
        labels = checkpointed(labels)
    return labels.drop("own_")


def community_levels(edges: DataFrame, levels: int = 3, least: int = 3, detect=communities) -> DataFrame:
    """(level, community, node): communities, and inside each of 2 * least members or more its parts, to so many levels.

    A part's name is its community's and its own. Parts count where a community has two or more of at
    least `least` members; members of smaller ones are in the part -1. All communities of a level are
    taken apart in one run, since an edge between two of them takes no part in it. `detect` finds communities:
    label propagation, or leiden.leiden, for which such a run has the weight of all communities together.
    """
    found = checkpointed(bucket_small(detect(edges), least).select(F.lit(0).alias("level"), "community", "node"))
    above, out = found, found
    for level in range(1, levels):
        large = above.filter("not endswith(community, '-1')").groupBy("community").count().filter(F.col("count") >= 2 * least).select("community")
        inside = above.join(large, "community")
        end = lambda c: inside.select(F.col("node").alias(c), F.col("community").alias(f"{c}_in"))
        within = edges.select("subject", "object").join(end("subject"), "subject").join(end("object"), "object").filter("subject_in = object_in")
        within = within.select(F.least("subject", "object").alias("subject"), F.greatest("subject", "object").alias("object"), F.lit(1).alias("weight")).distinct()
        parts = detect(checkpointed(within)).withColumnRenamed("community", "part").join(inside.select("node", "community"), "node")
        parts = parts.withColumn("n_", F.count("*").over(Window.partitionBy("community", "part"))).withColumn("part", F.when(F.col("n_") < least, "-1").otherwise(F.col("part")))
        real = parts.filter("part <> '-1'").groupBy("community").agg(F.count_distinct("part").alias("k_")).filter("k_ >= 2").select("community")
        above = checkpointed(parts.join(real, "community", "left_semi").select(F.lit(level).alias("level"), F.concat_ws(" / ", "community", "part").alias("community"), "node"))
        if above.isEmpty():
            break
        out = out.unionByName(above)
    return out


def bucket_small(members: DataFrame, least: int = 3) -> DataFrame:
    """Communities of fewer members become -1."""
    n = F.count("*").over(Window.partitionBy("community"))
    return members.withColumn("community", F.when(n < least, F.lit("-1")).otherwise(F.col("community")))


def community_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(community, change): new, removed, changed or unchanged by the members' sets."""
    sets = lambda df, name: df.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias(name))
    both = sets(old, "a").join(sets(new, "b"), "community", "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return both.select("community", change.alias("change"))


# ---------------------------------------------------------------- output


def notes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A Markdown note per entity with its links out and in."""
    link = lambda name, relation: F.concat(F.lit("- "), F.col(relation), F.lit(" [["), F.col(name), F.lit("]]"))
    out = edges.select(F.col("subject").alias("canonical"), F.struct(F.lit(0).alias("k"), link("object", "relation").alias("line")).alias("l"))
    into = edges.select(F.col("object").alias("canonical"), F.struct(F.lit(1).alias("k"), link("subject", "relation").alias("line")).alias("l"))
    lines = out.unionByName(into).groupBy("canonical").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return nodes.join(lines, "canonical", "left").select("canonical", F.concat_ws("\n", F.concat(F.lit("# "), F.col("canonical")), body).alias("note"))


def path_errors(hops: DataFrame, edge_types: DataFrame) -> DataFrame:
    """(pattern, place, problem): unknown edge types, and hops whose ends don't fit; unconstrained ends always fit."""
    typed = hops.join(edge_types, "relation", "left")
    w = Window.partitionBy("pattern").orderBy("place")
    following = typed.withColumns({"next_sources": F.lead("source_types").over(w), "next_relation": F.lead("relation").over(w)})
    unknown = following.filter(F.col("known").isNull()).select("pattern", "place", F.lit("unknown edge").alias("problem"))
    both = (F.size("target_types") > 0) & (F.size("next_sources") > 0)
    misfit = following.filter(both & ~F.arrays_overlap("target_types", "next_sources")).select("pattern", "place", F.lit("incompatible hop").alias("problem"))
    return unknown.unionByName(misfit)


def context_lines(triples: DataFrame, budget_chars: int, group: str = "query_id") -> DataFrame:
    """Per query its triples by predicate, the smallest groups cut first, within a budget of characters."""
    line = F.concat("subject", F.lit(" "), "relation", F.lit(" "), "object")
    rows = triples.select(group, "relation", line.alias("line"))
    sized = rows.groupBy(group, "relation").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("block"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "relation").rowsBetween(Window.unboundedPreceding, 0)
    kept = sized.withColumn("upto", F.sum(F.length("block") + 1).over(w)).filter(F.col("upto") <= budget_chars)
    return kept.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "relation", "block"))), lambda s: s["block"]), "\n").alias("context"))


def community_section(queries: DataFrame, summaries: DataFrame, touched: DataFrame, budget_tokens: int, opening: str, closing: str, chars_a_token: int = 4) -> DataFrame:
    """(query_id, section): the communities' summaries, most touched first; the least touched go until the lines fit the budget.

    summaries (community, summary) are few, so each query has all of them; touched: (query_id, community, n).
    Of equal counts the smaller community goes first, and stands first. A query for which nothing fits has no row.
    """
    lines = queries.select("query_id").crossJoin(summaries).join(touched, ["query_id", "community"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lines = lines.withColumn("line", F.format_string("[Community %s] (%s entities touched): %s", F.col("community").cast("string"), F.col("n").cast("string"), F.col("summary")))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("community")).rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("upto", F.sum(F.length("line")).over(w)).filter(F.col("upto") <= budget_tokens * chars_a_token)
    inner = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "community", "line"))), lambda x: x["line"])
    return kept.groupBy("query_id").agg(F.array_join(F.concat(F.array(F.lit(opening)), inner, F.array(F.lit(closing))), "\n").alias("section"))


REPLY_SCHEMA = "entities array<struct<name string, type string, description string>>, relationships array<struct<source string, relation string, target string>>"


def extracted(replies: DataFrame, node_types: list[str], edge_types: list[str], fallback: str) -> tuple[DataFrame, DataFrame]:
    """Entities (source, name, type, description) and triples (source, subject, relation, object) of a model's replies (source, reply).

    A reply may be fenced; one that is no JSON object gives nothing. Of a reply's entities of one name the
    first counts; an unknown type becomes the fallback. Triples with an empty part or an unknown relation go.
    """
    fenced = F.regexp_extract(T.strip(F.col("reply")), r"(?s)^```[^\n]*\n(.*?)(?:```)?$", 1)
    body = F.when(T.strip(F.col("reply")).startswith("```"), fenced).otherwise(F.col("reply"))
    rows = replies.select("source", F.from_json(body, REPLY_SCHEMA).alias("r"))
    named = rows.select("source", F.posexplode("r.entities").alias("place", "e")).select("source", "place", T.strip(F.col("e.name")).alias("name"), T.strip(F.coalesce("e.type", F.lit(fallback))).alias("type"), T.strip(F.col("e.description")).alias("description"))
    first = named.filter("name <> ''").groupBy("source", "name").agg(F.min(F.struct("place", "type", "description")).alias("f"))
    kind = F.when(F.col("f.type").isin(node_types), F.col("f.type")).otherwise(F.lit(fallback))
    entities = first.select("source", "name", kind.alias("type"), F.when(F.col("f.description") != "", F.col("f.description")).alias("description"))
    triples = rows.select("source", F.explode("r.relationships").alias("t")).select("source", *[T.strip(F.col(f"t.{c}")).alias(n) for c, n in (("source", "subject"), ("relation", "relation"), ("target", "object"))])
    return entities, triples.filter("subject <> '' and object <> ''").filter(F.col("relation").isin(edge_types))
