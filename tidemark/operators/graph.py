"""Graphs as nodes(id, ...) and edges(id, source, target, relation, weight, start_date, ...)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..session import shared_folder, stored

KEEP = 3


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, edge...) with every edge seen from both ends, self-loops once."""
    out = edges.withColumns({"node": F.col("source"), "other": F.col("target")})
    back = edges.filter("source <> target").withColumns({"node": F.col("target"), "other": F.col("source")})
    return out.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a self-loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def store_step(df: DataFrame) -> DataFrame:
    """Cut lineage in iterations by a reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def neighborhood(edges: DataFrame, start: DataFrame, depth: int, as_of: str | None = None) -> DataFrame:
    """(node, depth) within `depth` undirected hops of start (node). Edges dated after as_of are not walked, undated ones are."""
    if as_of is not None:
        edges = edges.filter(F.col("start_date").isNull() | (F.col("start_date") <= F.lit(as_of).cast("date")))
    step = both_ways(edges).select("node", "other").distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(step, "node").select(F.col("other").alias("node")).distinct()
        front = store_step(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = store_step(seen.unionByName(front))
    return seen


def incident_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges walked: those with an end nearer than `depth`."""
    inner = reached.filter(F.col("depth") < depth).select("node")
    hit = both_ways(edges).join(inner, "node", "left_semi")
    return hit.select(*edges.columns).distinct()


def collapse_minor(edges: DataFrame, relation: str = "ACQUIRED", threshold: int = 10, keep: int = KEEP) -> DataFrame:
    """Per target with more than `threshold` edges of the relation: the `keep` heaviest, and one edge for the rest.

    (source, target, weight, investors); the collapsed edge comes from collapsed_<target>.
    """
    own = edges.filter(F.col("relation") == relation)
    heaviest = F.row_number().over(Window.partitionBy("target").orderBy(F.desc_nulls_last("weight"), "id"))
    top = own.select("id", "target", "weight").withColumn("r", heaviest).filter(F.col("r") <= keep).select("id", F.lit(True).alias("top"))  # a limit by group ahead of the shuffle
    many = own.groupBy("target").agg(F.count("*").alias("n")).filter(F.col("n") > threshold).select("target", F.lit(True).alias("many"))
    marked = own.select("id", "source", "target", "weight").join(many, "target", "left").join(top, "id", "left")
    minor = F.col("many") & F.col("top").isNull()
    major = marked.filter(F.col("many").isNull() | F.col("top")).select("source", "target", "weight", F.lit(1).cast("long").alias("investors"))
    rest = marked.filter(minor).groupBy("target").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.count("*").alias("investors"))
    return major.unionByName(rest.select(F.concat(F.lit("collapsed_"), F.col("target").cast("string")).alias("source"), "target", "weight", "investors"))


def simple_paths(edges: DataFrame, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """(path, hops): all paths without repeated nodes between two nodes, at most max_depth edges, undirected, parallel edges apart.

    A fixed number of joins, each pruned to paths that have not arrived; path counts are inherent to the question.
    """
    step = both_ways(edges).select("node", "other", F.col("id").alias("edge"))
    walks = step.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>").withColumn("via", F.array().cast("array<string>"))
    found = []
    for _ in range(max_depth):
        ahead = walks.join(step, "node").filter(~F.array_contains("path", F.col("other")))
        walks = ahead.select(F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"), F.concat("via", F.array(F.col("edge").cast("string"))).alias("via"))
        found.append(walks.filter(F.col("node") == target))
        walks = walks.filter(F.col("node") != target)
    return reduce(DataFrame.unionByName, found).select("path", "via", F.size("via").alias("hops"))


def _levels(step: DataFrame, start: DataFrame, name: str) -> DataFrame:
    """(node, name) by breadth-first levels from start (node) until nothing new is reached, however many rounds that takes."""
    seen = front = start.select("node").distinct().withColumn(name, F.lit(0))
    for d in count(1):
        reached = front.join(step, "node").select(F.col("other").alias("node")).distinct()
        front = store_step(reached.join(seen, "node", "left_anti").withColumn(name, F.lit(d)))
        if front.isEmpty():
            return seen
        seen = store_step(seen.unionByName(front))


def shortest_hops(edges: DataFrame, source: str) -> DataFrame:
    """(node, hops) by breadth-first levels; stops when nothing new is reached."""
    step = both_ways(edges).select("node", "other").distinct()
    return _levels(step, step.sparkSession.createDataFrame([(source,)], "node string"), "hops")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(path, hops): one shortest undirected path, of several the first in the order of its node ids; no row without one.

    By levels that keep the smallest path to each new node; stops at the target or when nothing new is reached.
    """
    step = both_ways(edges).select("node", "other").distinct()
    front = step.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front
    while source != target:
        ahead = front.join(step, "node").groupBy("other").agg(F.min(F.concat("path", F.array("other"))).alias("path")).withColumnRenamed("other", "node")
        front = store_step(ahead.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty() or not front.filter(F.col("node") == target).isEmpty():
            break
        seen = store_step(seen.unionByName(front))
    return front.filter(F.col("node") == target).select("path", (F.size("path") - 1).alias("hops"))


def investors_like(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, label, type, relation, other_type, other_label, company, date): a row an edge of each person, organisation or
    company whose normalised label holds the normalised name, and the company that edge leads to; one row of nulls
    without edges. Issuer of a security and holder of a meeting are those of the first edge by id.

    What is found on the way is stored, as it is as small as what the name asks for: a join with it then needs no shuffle of the graph, and
    nodes and edges are narrowed to it ahead of any grouping.
    """
    key = K.entity_name(F.lit(name))
    people = stored(nodes.filter(F.col("type").isin("Person", "Organization", "Company") & (key != "") & F.contains(K.entity_name(F.col("label")), key)).select("id", "label", "type"), "people")
    ids = people.select(F.col("id").alias("node"))
    ends_of = edges.select("id", "source", "target", "relation", F.col("start_date").alias("date"))
    # both sides of an edge in one reading of the graph
    either = ends_of.select("relation", "date", F.inline(F.when(F.col("source") != F.col("target"), F.array(_way("source", "target"), _way("target", "source"))).otherwise(F.array(_way("source", "target")))))
    seen = stored(either.join(ids, "node").select("node", "other", "relation", "date"), "seen")
    others = seen.select("other").distinct()
    first = lambda relation, a, among: edges.filter(F.col("relation") == relation).select(F.col("target").alias(a), "source", "id").join(among.select(a), a, "left_semi").groupBy(a).agg(F.min_by("source", "id").alias("from"))
    events = stored(first("ISSUED", "other", others).withColumnRenamed("from", "event"), "events")
    issued = events.join(first("EXECUTED", "event", events), "event").select("other", F.col("from").alias("issuer"))
    held = first("HELD", "other", others).select("other", F.col("from").alias("holder"))
    ends = nodes.join(others.withColumnRenamed("other", "id"), "id", "left_semi").select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("label").alias("other_label"))
    firm = F.when(F.col("other").startswith("company_") & ~F.col("other").startswith("company_inv_"), F.col("other"))
    firm = firm.when((F.col("relation") == "ACQUIRED") & F.col("other").startswith("security_"), F.col("issuer")).when(F.col("other").startswith("shareholder_meeting_"), F.col("holder"))
    rich = stored(seen.join(ends, "other", "left").join(issued, "other", "left").join(held, "other", "left").withColumn("firm", firm), "seen")
    firms = nodes.join(rich.select(F.col("firm").alias("id")), "id", "left_semi").select(F.col("id").alias("firm"), F.col("label").alias("company"))
    rich = rich.join(firms, "firm", "left")
    return people.join(rich.withColumnRenamed("node", "id"), "id", "left").select("id", "label", "type", "relation", "other_type", "other_label", "company", "date")


def _way(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("node"), F.col(b).alias("other"))


def control_chain(edges: DataFrame, start: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Nodes reached from start along directed rules (prefix of the present node, relation, forward?), to the fixpoint."""
    steps = [
        edges.filter((F.col("relation") == rel) & F.col("source" if forward else "target").startswith(prefix)).select(F.col("source" if forward else "target").alias("node"), F.col("target" if forward else "source").alias("other"))
        for prefix, rel, forward in rules
    ]
    return _levels(reduce(DataFrame.unionByName, steps).distinct(), start, "depth")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Edges with slot and count among those of the same ends and relation; curvature 0.55 for self-loops."""
    w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"), "relation")
    out = edges.withColumns({"slot": F.row_number().over(w.orderBy("id")) - 1, "n": F.count("*").over(w)})
    return out.withColumn("curvature", F.when(F.col("source") == F.col("target"), F.lit(0.55)).when(F.col("n") == 1, F.lit(0.0)).otherwise((F.col("slot") - (F.col("n") - 1) / 2) * 0.25))


def shared_properties(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, key, value) for nodes of one property value, a star from the smallest id: hot values make n - 1 links, not n squared.

    all_pairs() lists every pair where that is wanted and values are rare.
    """
    long = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lower(F.trim(F.col(k).cast("string"))).alias("value")) for k in keys])).alias("p")).select("id", "p.key", "p.value").filter("value <> ''")
    first = long.groupBy("key", "value").agg(F.min("id").alias("a"))
    return long.join(first, ["key", "value"]).filter("id <> a").select("a", F.col("id").alias("b"), "key", "value")


def all_pairs(nodes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Every pair of nodes of one property value, as the viewer draws them; an error if a value has more than `most` nodes."""
    long = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lower(F.trim(F.col(k).cast("string"))).alias("value")) for k in keys])).alias("p")).select("id", "p.key", "p.value").filter("value <> ''")
    counts = long.groupBy("key", "value").agg(F.count("*").alias("n"))
    checked = long.join(counts, ["key", "value"]).filter(F.when(F.col("n") > most, F.raise_error(F.lit("too many nodes share a value")).cast("boolean")).otherwise(F.lit(True)))
    return checked.alias("x").join(long.alias("y"), ["key", "value"]).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "key", "value")


def risks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): high for more than 5 edges that are all of category address; medium for persons of degree over 3, which overrides."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "category")
    sums = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min(F.col("category") == "address").alias("only_address"))
    both = sums.join(nodes.select(F.col("id").alias("node"), "type"), "node")
    return both.select("node", F.when((F.col("type") == "Person") & (F.col("degree") > 3), F.lit("medium")).when(F.col("only_address") & (F.col("degree") > 5), F.lit("high")).alias("level")).filter("level IS NOT NULL")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select(F.col("id").alias("node"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("node"))
    bad = ends.join(ids, "node", "left_anti").select("id").distinct()
    return edges.join(bad, "id", "left_semi")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, issue, subject): duplicate ids, missing ends and weights of 0 or less are errors; loops, repeats and blank labels warn."""
    issue = lambda df, level, name, subject: df.select(F.lit(level).alias("level"), F.lit(name).alias("issue"), F.col(subject).cast("string").alias("subject"))
    repeated = lambda df: df.groupBy("id").count().filter("count > 1")
    same = edges.groupBy("source", "target", "relation").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1")
    return reduce(
        DataFrame.unionByName,
        [
            issue(repeated(nodes), "error", "duplicate node", "id"),
            issue(repeated(edges), "error", "duplicate edge", "id"),
            issue(dangling(nodes, edges), "error", "missing end", "id"),
            issue(edges.filter("weight <= 0"), "error", "weight not positive", "id"),
            issue(edges.filter("source = target"), "warning", "self-loop", "id"),
            issue(same, "warning", "repeated edge", "id"),
            issue(nodes.filter("label IS NULL OR trim(label) = ''"), "warning", "blank label", "id"),
        ],
    )


def visible(nodes: DataFrame, edges: DataFrame, node_where, edge_where, hide_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """The subgraph of nodes and edges that pass; edges need both ends."""
    shown = nodes.filter(node_where)
    ids = shown.select("id")
    kept = edges.filter(edge_where).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if hide_isolated:
        used = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        shown = shown.join(used, "id", "left_semi")
    return shown, kept


@dataclass(frozen=True)
class Filters:
    """What a viewer shows. Empty lists, zeros and "all" are no criteria."""

    types: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    min_degree: int = 0
    relations: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    min_weight: float = 0
    direction: str = "all"  # or directed, undirected
    any_of: bool = False  # one criterion is enough
    hide_isolated: bool = False

    def __post_init__(self) -> None:
        if self.direction not in ("all", "directed", "undirected"):
            raise ValueError(f"unknown direction {self.direction!r}")

    def _joined(self, checks: list[Column]) -> Column:
        return reduce((lambda a, b: a | b) if self.any_of else (lambda a, b: a & b), checks) if checks else F.lit(True)

    def nodes(self) -> Column:
        """Over (type, group, tags, degree)."""
        checks = []
        if self.types:
            checks.append(F.col("type").isin(*self.types))
        if self.groups:
            checks.append(F.coalesce("group", F.lit("")).isin(*self.groups))
        if self.tags:
            checks.append(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in self.tags])))
        if self.min_degree > 0:
            checks.append(F.col("degree") >= self.min_degree)
        return F.coalesce(self._joined([F.coalesce(c, F.lit(False)) for c in checks]), F.lit(False))

    def edges(self) -> Column:
        """Over (relation, category, weight, directed)."""
        checks = []
        if self.relations:
            checks.append(F.col("relation").isin(*self.relations))
        if self.categories:
            checks.append(F.col("category").isin(*self.categories))
        if self.min_weight > 0:
            checks.append(F.col("weight") >= self.min_weight)
        if self.direction != "all":
            checks.append(F.col("directed") == F.lit(self.direction == "directed"))
        return self._joined([F.coalesce(c, F.lit(False)) for c in checks])


def _holds(words: str, *texts: Column, properties: Column) -> Column:
    named = F.transform(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>"))), lambda p: F.concat_ws(":", p["key"], F.coalesce(p["value"], F.lit(""))))
    inside = lambda c: F.contains(F.lower(c), F.lit(words))
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(inside(t), F.lit(False)) for t in texts]) | F.exists(named, inside), F.lit(False))


def visible_subgraph(nodes: DataFrame, edges: DataFrame, filters: Filters | None = None, search: str = "", hidden_nodes: DataFrame | None = None, hidden_edges: DataFrame | None = None, root: str | None = None, hops: int = 0) -> tuple[DataFrame, DataFrame]:
    """What a viewer shows of nodes(id, label, type, group, tags, properties) and edges(id, source, target, relation, category, weight, directed, properties).

    Nodes must pass the criteria (degrees are those of the whole graph), hold the search words in any text or property, lie within `hops` of root if one
    is given, and not be hidden. Edges need both ends, must pass their own criteria and not be hidden; the search asks nothing more of an edge whose ends
    are shown. Then, with hide_isolated, nodes without a shown edge go. Node sets meet edges in semi-joins by id.
    """
    f = filters or Filters()
    shown = nodes
    if f.min_degree > 0:
        shown = shown.join(degrees(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    shown = shown.filter(f.nodes())
    words = search.strip().lower()
    if words:
        shown = shown.filter(_holds(words, F.col("id"), F.col("label"), F.col("type"), F.col("group"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\n"), properties=F.col("properties")))
    if root is not None and hops > 0:
        start = nodes.sparkSession.range(1).select(F.lit(root).alias("node"))
        shown = shown.join(neighborhood(edges, start, hops).select(F.col("node").alias("id")), "id", "left_semi")
    if hidden_nodes is not None:
        shown = shown.join(hidden_nodes.select("id"), "id", "left_anti")
    kept = edges.filter(f.edges())
    if hidden_edges is not None:
        kept = kept.join(hidden_edges.select("id"), "id", "left_anti")
    for end in ("source", "target"):
        kept = kept.join(shown.select(F.col("id").alias(end)), end, "left_semi")
    if f.hide_isolated:
        shown = shown.join(kept.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id", "left_semi")
    return shown.select(*nodes.columns), kept.select(*edges.columns)
