"""Queries over the operators, with independent SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.rng import uniform, uniform_sql
from lattiq.functions.lineage import saved
from lattiq.operators import coarsen, communities, convergence, export, graph, knn, layout, metrics, partition, similarity
from lattiq.sources import files
from lattiq.plans.fixtures import ARCS, GEO, NATION_LEVEL, NODES, PART_SUPP, VECTOR_LAYOUT, VECTORS, geo, geo_layout, geo_layout_sql, nation_level, part_supp, scratch, table, vector_layout, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"


def distance_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def knn_sql(k: int, name: str = "knn") -> str:
    return f"""{name}_pairs as (select a.id, b.id as nbr, {distance_sql('a.v', 'b.v')} as d2 from vectors a join vectors b on a.id <> b.id),
{name} as (select * from (select id, nbr, cast(row_number() over (partition by id order by d2, nbr) as int) as rank, d2 from {name}_pairs) where rank <= {k})"""


# kNN graphs


@query(with_(VECTORS, knn_sql(10)) + "select id, nbr, rank, round(d2, 6) as d2 from knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact(vectors(spark, sf_dir), 10), "d2")


@query(with_(VECTORS, """pairs as (
    select a.id, b.id as nbr, 2 - 2 * list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))
        / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))) as d2
    from vectors a join vectors b on a.id <> b.id)""") + "select * from (select id, nbr, cast(row_number() over (partition by id order by d2, nbr) as int) as rank, round(d2, 6) as d2 from pairs) where rank <= 10")  # fmt: skip
def knn_angular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact(vectors(spark, sf_dir), 10, "angular"), "d2")


@query(with_(VECTORS, "near as (select a.id, b.id as nbr, " + distance_sql("a.v", "b.v") + " as d2 from vectors a, vectors b where a.id = 7)") + "select * from (select cast(id as bigint) as id, nbr, cast(row_number() over (order by d2, nbr) as int) as rank, round(d2, 6) as d2 from near) where rank <= 10")
def knn_of_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.nearest_of_row(vectors(spark, sf_dir), 7, 10), "d2")


@query(with_(VECTORS, """long as (select id, unnest(range(0, len(v))) as dim, unnest(v) as x from vectors),
means as (select dim, avg(x) as m from long group by dim),
centred as (select id, long.dim, x - m as x from long join means on long.dim = means.dim)""") + "select id, cast(dim as int) as dim, round(x / (select max(abs(x)) from centred), 6) as x from centred")  # fmt: skip
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = knn.normalise(vectors(spark, sf_dir)).select("id", F.posexplode("v").alias("dim", "x"))
    return rounded(made, "x")


def bad_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    n = rows.count()
    return rows.select("id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).select("id", ((F.col("id") + F.col("rank")) % n).alias("nbr"), "rank")


def propagate_sql(rounds: int = 3) -> str:
    out = ["start as (select id, (id + j) % (select count(*) from vectors) as nbr from vectors, range(1, 11) t(j))"]
    last = "start"
    for r in range(1, rounds + 1):
        out.append(f"""pairs{r} as materialized (
    select p.id, p.nbr, {distance_sql('a.v', 'b.v')} as d2
    from (select id, nbr from {last} union select x.id, y.nbr from {last} x join {last} y on x.nbr = y.id where x.id <> y.nbr) p
    join vectors a on a.id = p.id join vectors b on b.id = p.nbr where p.id <> p.nbr),
near{r} as materialized (select * from (select id, nbr, cast(row_number() over (partition by id order by d2, nbr) as int) as rank, d2 from pairs{r}) where rank <= 10)""")
        last = f"near{r}"
    return ",\n".join(out)


@query(with_(VECTORS, propagate_sql()) + "select id, nbr, rank, round(d2, 6) as d2 from near3")
def knn_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.propagate(bad_start(spark, sf_dir), vectors(spark, sf_dir), 10, 3), "d2")


@query(with_(VECTORS, propagate_sql(), knn_sql(10)) + """select count(n.nbr) as hits, count(*) as wanted, count(n.nbr) / count(*) as recall
from knn left join near3 n on knn.id = n.id and knn.nbr = n.nbr""")
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.recall(knn.propagate(bad_start(spark, sf_dir), rows, 10, 3), knn.exact(rows, 10), 10)


CODES = """codes as (
    select id, t as tbl, cast(list_sum(list_transform(range(0, 8), lambda i: case when v[t * 8 + i + 1] > 0 then cast(pow(2, i) as bigint) else 0 end)) as bigint) as code
    from vectors, range(0, 4) r(t)),
pool as (
    select a.id, b.id as nbr, min(bit_count(xor(a.code, b.code))) as radius
    from codes a join codes b on a.tbl = b.tbl and a.id <> b.id where bit_count(xor(a.code, b.code)) <= 2 group by a.id, b.id)"""


@query(with_(VECTORS, CODES, f"pairs as (select p.id, p.nbr, {distance_sql('a.v', 'b.v')} as d2 from pool p join vectors a on a.id = p.id join vectors b on b.id = p.nbr)") + "select * from (select id, nbr, cast(row_number() over (partition by id order by d2, nbr) as int) as rank, round(d2, 6) as d2 from pairs) where rank <= 10")
def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.hamming(vectors(spark, sf_dir), 10, bits=8), "d2")


@query(with_(VECTORS, CODES, """held as (select id, radius, sum(count(*)) over (partition by id order by radius) as held from pool group by id, radius),
filled as (select id, coalesce(min(radius) filter (held >= 30), max(radius)) as radius from held group by id)""") + "select cast(radius as int) as radius, count(*) as n from filled group by radius")  # fmt: skip
def radius_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = knn.sign_codes(vectors(spark, sf_dir))
    return knn.radius_histogram(knn.hamming_counts(codes, codes, 2), 30)


@query(with_(VECTORS, CODES) + "select cast(tbl as int) as tbl, code, count(*) as n, min(id) as first from codes group by tbl, code")
def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.hash_table(knn.sign_codes(vectors(spark, sf_dir))).select("tbl", "code", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"))


@query()
def knn_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.forest(vectors(spark, sf_dir), 10), "d2")


@query()
def knn_kd_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.merged_leaves(vectors(spark, sf_dir), 10), "d2")


@query()
def knn_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.nn_descent(vectors(spark, sf_dir), 10), "d2")


@query()
def knn_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = knn.KnnIndex.build(rows.select("id", "v"), "exact", 10)
    return rounded(index.search(rows.select("id", "v"), 5), "d2")


ENOUGH = "select count(*) * %d as wanted, true as enough from embeddings"


def enough(found: DataFrame, rows: DataFrame, k: int, truth: DataFrame | None = None) -> DataFrame:
    """Whether at least 0.9 of the true neighbours were found."""
    return knn.recall(found, knn.exact(rows, k) if truth is None else truth, k).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query(ENOUGH % 10)
def forest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return enough(knn.forest(rows, 10), rows, 10)


@query(ENOUGH % 10)
def kd_leaves_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf mates of variance-split trees, as start lists of a propagation."""
    rows = vectors(spark, sf_dir)
    return enough(knn.propagate(knn.merged_leaves(rows, 10, trees=16, leaf=120), rows, 10), rows, 10)


@query(ENOUGH % 10)
def nn_descent_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return enough(knn.nn_descent(rows, 10), rows, 10)


@query(ENOUGH % 5)
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of the index for its own rows, which are their own nearest."""
    rows = vectors(spark, sf_dir).select("id", "v")
    index = knn.KnnIndex.build(rows, "exact", 10)
    return enough(index.search(rows, 5), rows, 5, knn.block_join(rows, rows, 5, keep_self=True))


@query()
def knn_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by trees of an index that was saved and loaded."""
    path, rows = scratch(spark, "forest"), vectors(spark, sf_dir).select("id", "v")
    knn.KnnIndex.build(rows, "exact", 10, search_trees=10).save(path)
    return rounded(knn.KnnIndex.load(spark, path).search(rows, 5, "trees"), "d2")


@query(ENOUGH % 5)
def forest_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "v")
    index = knn.KnnIndex.build(rows, "exact", 10, search_trees=10)
    return enough(index.search(rows, 5, "trees"), rows, 5, knn.block_join(rows, rows, 5, keep_self=True))


@query("select cast(t as int) as tree, count(*) as n, count(distinct vec_id) as ids from embeddings, range(0, 10) r(t) group by t")
def forest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree holds every row once."""
    index = knn.KnnIndex.build(vectors(spark, sf_dir).select("id", "v"), "exact", 10, search_trees=10)
    return index.held.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


# Files


@query(with_(VECTORS) + "select id, cast(unnest(range(0, len(v))) as int) as dim, round(unnest(v), 6) as x from (select row_number() over (order by id) - 1 as id, v from vectors)")
def file_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "vectors")
    files.write_vectors(vectors(spark, sf_dir), path)
    return rounded(files.read_vectors(spark, path).select("id", F.posexplode("v").alias("dim", "x")), "x")


@query(with_(PART_SUPP) + "select u, v, w from edges")
def file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "graph")
    files.write_graph(part_supp(spark, sf_dir), path)
    return files.read_graph(spark, path)


@query(with_(GEO, NODES, geo_layout_sql()) + "select row_number() over (order by id) - 1 as id, round(x, 6) as x, round(y, 6) as y from layout")
def file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "layout")
    files.write_layout(geo_layout(graph.vertices(geo(spark, sf_dir))), path)
    return rounded(files.read_layout(spark, path), "x", "y")


@query("select row_number() over (order by vec_id) - 1 as id, cast(label as int) as label from embeddings")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "labels")
    files.write_labels(vectors(spark, sf_dir), path)
    return files.read_labels(spark, path)


@query("select max(label) + 1 as classes from embeddings")
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "labels")
    files.write_labels(vectors(spark, sf_dir), path)
    return files.classes(files.read_labels(spark, path))


@query(with_(VECTORS, knn_sql(10)) + "select dense_rank() over (order by id) - 1 as id, nbr, rank from knn")
def file_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "knn")
    files.write_knn(knn.exact(vectors(spark, sf_dir), 10), path)
    return files.read_knn(spark, path)


@query(with_(NATION_LEVEL) + "select row_number() over (order by cluster) - 1 as at, string_agg(cast(id as varchar), ' ' order by id) as line from level group by cluster")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "groups")
    files.write_groups(nation_level(spark, sf_dir).select("id", F.col("cluster").alias("community")), path)
    return files.lines(spark, path).select("at", F.array_join("fields", " ").alias("line"))


@query(with_(VECTORS) + "select a.id, " + distance_sql("a.v", "b.v") + " as d2 from vectors a, vectors b where a.id = 5 and b.id = 3")
def index_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of two rows of an index that was saved and loaded."""
    path, rows = scratch(spark, "index"), vectors(spark, sf_dir).select("id", "v")
    knn.KnnIndex.build(rows, "exact", 10).save(path)
    return knn.KnnIndex.load(spark, path).distance(5, 3).select(F.lit(5).cast("long").alias("id"), "d2")


@query(with_(VECTORS, knn_sql(10)) + "select least(id, nbr) as u, greatest(id, nbr) as v, 0.0::double as w from knn where rank <= 2 group by least(id, nbr), greatest(id, nbr)")
def edges_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.prefix_edges(knn.exact(vectors(spark, sf_dir), 10), 2)


@query(with_(VECTORS, knn_sql(10)) + "select id as src, nbr as dst, round(d2, 6) as w from knn where nbr < (select count(*) from vectors)")
def knn_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.to_arcs(knn.exact(vectors(spark, sf_dir), 10), vectors(spark, sf_dir).count()), "w")


# Similarities

PERPLEXITY = """lists as (select id, list(d2 order by rank) as ds, list(nbr order by rank) as nbrs from knn group by id),
state as (
    select id, ds, 1.0::double as beta, null::double as low, null::double as high, 0 as n, false as done from lists
    union all
    select id, ds,
        case when abs(gap) < 1e-5 then beta when gap > 0 then case when high is null then beta * 2 else (beta + high) / 2 end
            else case when low is null then beta / 2 else (beta + low) / 2 end end,
        case when abs(gap) >= 1e-5 and gap > 0 then beta else low end,
        case when abs(gap) >= 1e-5 and gap <= 0 then beta else high end, n + 1, abs(gap) < 1e-5
    from (select *, list_sum(list_transform(ds, lambda d: beta * d * exp(-beta * d))) / list_sum(list_transform(ds, lambda d: exp(-beta * d)))
            + ln(list_sum(list_transform(ds, lambda d: exp(-beta * d)))) - ln(5.0) as gap from state where n < 200 and not done)),
best as (select id, arg_max(beta, n) as beta from state group by id),
alike as (
    select id as src, unnest(nbrs) as dst, unnest(list_transform(ds, lambda d: exp(-beta * d) / mass)) as w
    from (select lists.*, beta, list_sum(list_transform(ds, lambda d: exp(-beta * d))) as mass from lists join best on lists.id = best.id))"""


@query(with_(VECTORS, knn_sql(10), PERPLEXITY, recursive=True) + "select src, dst, round(w, 6) as w from alike")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.perplexity(knn.exact(vectors(spark, sf_dir), 10), 5), "w")


@query(with_(VECTORS, knn_sql(10), PERPLEXITY, "pairs as (select least(src, dst) as u, greatest(src, dst) as v, sum(w) / 2 as w from alike group by least(src, dst), greatest(src, dst))", recursive=True) + "select u as src, v as dst, round(w, 6) as w from pairs union all select v, u, round(w, 6) from pairs")
def similarity_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.knn_similarity(knn.exact(vectors(spark, sf_dir), 10), 5), "w")


@query(with_(PART_SUPP, ARCS) + "select src, dst, round(exp(-floor(w)) * (select count(distinct src) from arcs) / (select sum(exp(-floor(w))) from arcs), 8) as w from arcs")
def graph_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.graph_similarity(part_supp(spark, sf_dir)), "w", digits=8)


@query(with_(PART_SUPP, ARCS) + "select src as id, sum(w) as degree, round(pow(sum(w), 0.75), 6) as weight from arcs group by src")
def neg_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.sampling_weights(graph.arcs(part_supp(spark, sf_dir))), "weight")


CUMULATIVE = "weights as (select src as id, pow(sum(w), 0.75) as weight from arcs group by src), parts as (select id, sum(weight) over (order by id) as top, weight, sum(weight) over () as total from weights)"


@query(with_(PART_SUPP, ARCS, CUMULATIVE) + "select id, round((top - weight) / total, 6) as low, round(top / total, 6) as high from parts")
def cum_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = similarity.sampling_weights(graph.arcs(part_supp(spark, sf_dir)))
    return rounded(similarity.cumulative(weights).select("id", "low", "high"), "low", "high")


@query(with_(PART_SUPP, ARCS, CUMULATIVE, f"points as (select cast(i as bigint) as draw, {uniform_sql('i', 9)} as u from range(0, 500) r(i))") + "select draw, id from points join parts on u >= (top - weight) / total and u < top / total")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = similarity.cumulative(similarity.sampling_weights(graph.arcs(part_supp(spark, sf_dir))))
    points = spark.range(500).select(F.col("id").alias("draw"), uniform("id", 9).alias("u"))
    return similarity.draws(weights.select("id", "low", "high"), points).select("draw", "id")


# Graphs

WALKS = """walks as (
    select id as src, id, 0 as dist from nodes
    union select w.src, a.dst, w.dist + 1 from walks w join arcs a on a.src = w.id where w.dist < %d),
far as (select src, id, min(dist) as dist from walks group by src, id)"""


@query(with_(GEO, ARCS, NODES, WALKS % 2, recursive=True) + "select src, id, cast(dist as int) as dist from far")
def bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(geo(spark, sf_dir), depth=2)


@query(with_(GEO, ARCS, NODES, WALKS % 6, recursive=True) + "select src, id, cast(dist as int) as dist from far")
def bfs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(geo(spark, sf_dir))


@query(with_(GEO, ARCS, NODES, WALKS % 2, recursive=True) + "select u, v, w from edges union all select src, id, cast(dist as double) from far where dist > 1 and src < id")
def two_hop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.within(geo(spark, sf_dir), 2)


@query(with_(GEO, ARCS, NODES, WALKS % 6, recursive=True) + "select src as id, min(id) as component from far group by src")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(geo(spark, sf_dir))


@query(with_(GEO, ARCS, NODES, WALKS % 6, """parts as (select src as id, min(id) as c from far group by src),
sizes as (select c, count(*) as n from parts group by c)""", recursive=True) + "select count(*) as components, max(n) as largest, (select max(d) from (select count(*) as d from arcs group by src)) as max_degree from sizes")  # fmt: skip
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connectivity(geo(spark, sf_dir))


MODULARITY = with_(GEO, ARCS, NODES, WALKS % 6, """parts as (select src as id, min(id) as community from far group by src),
ends as (select p.community, q.community as other from edges e join parts p on p.id = e.u join parts q on q.id = e.v)""", recursive=True)  # fmt: skip


@query(with_(GEO, NATION_LEVEL, """m as (select count(*) as m from edges),
both_ends as (select a.cluster as cu, b.cluster as cv from edges join level a on a.id = u join level b on b.id = v),
ends as (select c as community, count(*) as ends from (select cu as c from both_ends union all select cv from both_ends) group by c),
inside as (select cu as community, count(*) as inside from both_ends where cu = cv group by cu)""") + """select ends.community, round(coalesce(inside, 0) / m, 8) as inside, round(ends / (2 * m), 8) as ends,
    round(coalesce(inside, 0) / m - (ends / (2 * m)) * (ends / (2 * m)), 8) as q
from ends left join inside on ends.community = inside.community, m""")  # fmt: skip
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership = nation_level(spark, sf_dir).select("id", F.col("cluster").alias("community"))
    return rounded(graph.modularity(geo(spark, sf_dir), membership), "inside", "ends", "q", digits=8)


@query(with_(GEO, ARCS, "degree as (select src as id, count(*) as d from arcs group by src), m as (select count(*) as m from edges)") + "select src as i, dst as j, round(2 * (1 / (2 * m) - a.d * b.d / (4 * m * m)), 10) as dq from arcs join degree a on a.id = src join degree b on b.id = dst, m")
def delta_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.delta_q(geo(spark, sf_dir)), "dq", digits=10)


@query(with_(GEO, ARCS, NODES, WALKS % 6, "parts as (select count(distinct c) as c from (select min(id) as c from far group by src))", recursive=True) + "select (select count(*) from nodes) - c as merges, c as communities from parts")
def greedy_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a cut, merging ends with the connected components."""
    steps, found = communities.greedy(geo(spark, sf_dir))
    return steps.agg(F.count("*").alias("merges")).join(found.agg(F.count_distinct("community").alias("communities")), F.lit(True))


@query()
def greedy_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(communities.greedy(geo(spark, sf_dir))[0], "dq", "q")


@query(with_(NATION_LEVEL, "sizes as (select cluster, count(*) as size from level group by cluster)") + "select size, count(*) as n, count(*) / (select count(*) from sizes) as share from sizes group by size")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.sizes(nation_level(spark, sf_dir).select("id", F.col("cluster").alias("community")))


@query(with_(GEO, NATION_LEVEL, "both_ends as (select a.cluster as cu, b.cluster as cv from edges join level a on a.id = u join level b on b.id = v)") + "select least(cu, cv) as u, greatest(cu, cv) as v, cast(count(*) as double) as w from both_ends where cu <> cv group by least(cu, cv), greatest(cu, cv)")
def community_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.coarse_network(geo(spark, sf_dir), nation_level(spark, sf_dir).select("id", F.col("cluster").alias("community")))


# Metrics

STRESS = "select round(s1 / s2, 8) as alpha, round(((s1 / s2) * (s1 / s2) * s2 - 2 * (s1 / s2) * s1 + n) / %s, 8) as stress"


@query(with_(GEO, NODES, geo_layout_sql(), "d as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from edges join layout a on a.id = u join layout b on b.id = v), sums as (select sum(d) as s1, sum(d * d) as s2, count(*) as n from d)") + STRESS % "n" + " from sums")
def stress_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    return rounded(metrics.stress_neighbour(edges, geo_layout(graph.vertices(edges))), "alpha", "stress", digits=8)


@query(with_(GEO, ARCS, NODES, geo_layout_sql(), WALKS % 6, """d as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / dist as r from far join layout a on a.id = far.src join layout b on b.id = far.id where dist > 0),
sums as (select sum(r) as s1, sum(r * r) as s2, count(*) as n, (select count(*) from nodes) as k from d)""", recursive=True) + STRESS % "(k * k)" + ", k as sources, n as pairs from sums")  # fmt: skip
def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    return rounded(metrics.stress(edges, geo_layout(graph.vertices(edges))), "alpha", "stress", digits=8)


@query(with_(PART_SUPP, ARCS, NODES, geo_layout_sql(), """near as (select w / (select count(*) from nodes) as p, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) as q from arcs join layout a on a.id = src join layout b on b.id = dst)""") + "select round(sum(p * ln(p / (q / (select sum(q) from near)))), 6) as kl from near")
def kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_supp(spark, sf_dir)
    return rounded(metrics.kl_divergence(edges, geo_layout(graph.vertices(edges))), "kl")


@query(with_(GEO, ARCS, NODES, geo_layout_sql(), WALKS % 2, """near as (select src as id, id as nbr from far where dist > 0),
k as (select id, count(*) as k from near group by id),
shown as (select id, nbr from (
    select a.id, b.id as nbr, row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as rank
    from layout a join layout b on a.id <> b.id) r join k using (id) where rank <= k.k),
hits as (select s.id, count(n.nbr) as common, count(*) as s from shown s left join near n on n.id = s.id and n.nbr = s.nbr group by s.id)""", recursive=True) + "select round(avg(common / (k + s - common)), 8) as jaccard, count(*) as n from hits join k using (id)")  # fmt: skip
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    return rounded(metrics.jaccard(edges, geo_layout(graph.vertices(edges)), 2), "jaccard", digits=8)


HOLDOUT = f"test as (select id, label from (select id, label, row_number() over (order by {uniform_sql('id', 7)}, id) as r from vectors) where r <= (select count(*) // 10 from vectors))"


@query(with_(VECTORS, HOLDOUT) + "select id from test")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.holdout(vectors(spark, sf_dir)).select("id")


@query(with_(VECTORS, HOLDOUT, """flat as (select id, v[1] as x, v[2] as y, label from vectors),
near as (select * from (
    select a.id, b.label, row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as rank
    from flat a join flat b on true where a.id in (select id from test) and b.id not in (select id from test)) where rank <= 50),
counted as (select id, k, label, count(*) as n from near, (values (1), (5), (10), (20), (30), (40), (50)) c(k) where rank <= k group by id, k, label),
voted as (select id, k, arg_min(label, (-n, label)) as label from counted group by id, k)""") + """select cast(k as int) as k, cast(sum(case when v.label = t.label then 1 else 0 end) as bigint) as hits, count(*) as tested,
    sum(case when v.label = t.label then 1 else 0 end) * 100.0 / count(*) as accuracy from voted v join test t on v.id = t.id group by k""")  # fmt: skip
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return metrics.knn_accuracy(rows.select("id", F.slice("v", 1, 2).alias("v")), rows.select("id", "label"))


# Coarsening

LEVEL_COLUMNS = "id, sun, cast(kind as int) as kind"


def independent_sql(rounds: int) -> str:
    """A greedy independent set over ``near`` (src, dst) by the rank ``p`` of ``ranked`` (id, p)."""
    out = ["s0 as materialized (select id, p, null::boolean as chosen from ranked)"]
    for r in range(1, rounds + 1):
        last = f"s{r - 1}"
        out.append(f"""w{r} as materialized (
    select o.id from {last} o where o.chosen is null and not exists (
        select 1 from near n join {last} q on q.id = n.dst where n.src = o.id and q.chosen is null and q.p < o.p)),
s{r} as materialized (
    select id, p, case when chosen is not null then chosen when id in (select id from w{r}) then true
        when id in (select n.dst from near n join w{r} w on w.id = n.src) then false end as chosen from {last})""")
    return ",\n".join([*out, f"suns as (select id from s{rounds} where chosen)"])


SOLAR_PARTS = (GEO, ARCS, NODES, """near as materialized (select distinct src, dst from (
    select src, dst from arcs union all select a.src, b.dst from arcs a join arcs b on a.dst = b.src) where src <> dst)""",
    f"ranked as materialized (select id, row_number() over (order by {uniform_sql('id', 1)}, id) as p from nodes)", independent_sql(12),
    """planets as (select a.dst as id, s.id as sun, a.w as dist from arcs a join suns s on s.id = a.src),
rest as (select id from nodes where id not in (select id from suns) and id not in (select id from planets)),
moons as (
    select r.id, arg_min(p.id, (a.w, p.id)) as planet, arg_min(p.sun, (a.w, p.id)) as sun, arg_min(p.dist + a.w, (a.w, p.id)) as dist
    from rest r join arcs a on a.src = r.id join planets p on p.id = a.dst group by r.id)""")  # fmt: skip
SOLAR_ROWS = """select id, id as sun, 1 as kind, 0.0::double as dist from suns
union all select id, sun, case when id in (select planet from moons) then 3 else 2 end, dist from planets
union all select id, sun, 4, dist from moons"""
SOLAR = with_(*SOLAR_PARTS) + SOLAR_ROWS


@query(SOLAR)
def coarsen_solar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.solar(geo(spark, sf_dir))


@query(with_(PART_SUPP, ARCS, NODES, "near as materialized (select distinct src, dst from arcs where src <> dst)",
    f"ranked as materialized (select id, row_number() over (order by -(select sum(w) from arcs where src = nodes.id), {uniform_sql('id', 1)}, id) as p from nodes)", independent_sql(12)) + """select id, id as sun, 1 as kind from suns
union all select n.src, arg_min(n.dst, r.p), 2 from near n join suns s on s.id = n.dst join ranked r on r.id = n.dst where n.src not in (select id from suns) group by n.src""")  # fmt: skip
def coarsen_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.normal(part_supp(spark, sf_dir))


COARSE = "both_ends as (select a.cluster as cu, b.cluster as cv, w + a.dist + b.dist as w from edges join level a on a.id = u join level b on b.id = v)"


@query(with_(GEO, NATION_LEVEL, COARSE) + "select least(cu, cv) as u, greatest(cu, cv) as v, avg(w) as w, count(*) as n from both_ends where cu <> cv group by least(cu, cv), greatest(cu, cv)")
def coarse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.coarse_edges(geo(spark, sf_dir), nation_level(spark, sf_dir))


@query(with_(NATION_LEVEL, "second as (select distinct cluster as id, coalesce(n_regionkey, cluster) as region from level left join nation on n_nationkey + 100 = cluster)") + "select level.id, cast(region as bigint) as cluster from level join second on second.id = level.cluster")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = nation_level(spark, sf_dir).select("id", "cluster")
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"))
    second = first.select(F.col("cluster").alias("id")).distinct().join(nation, "id", "left").select("id", F.coalesce("region", "id").alias("cluster"))
    return coarsen.compose(first, second)


@query(with_(NATION_LEVEL) + "select cluster, count(*) as mass, sum(dist) as similarity from level group by cluster")
def cluster_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = nation_level(spark, sf_dir)
    return coarsen.masses(level).join(coarsen.rolled_up(level.select("id", F.col("dist").alias("similarity")), level), "cluster")


@query(with_(GEO, ARCS, NATION_LEVEL) + """select src as id, b.sun as other, a.dist / (w + a.dist + b.dist) as part
from arcs join level a on a.id = src join level b on b.id = dst where a.sun <> b.sun""")
def lambda_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.lambdas(geo(spark, sf_dir), nation_level(spark, sf_dir))


@query(with_(*SOLAR_PARTS, f"level as materialized ({SOLAR_ROWS})", """pairs as (
    select distinct least(a.sun, b.sun) as u, greatest(a.sun, b.sun) as v from edges e join level a on a.id = e.u join level b on b.id = e.v where a.sun <> b.sun)""") + """select 0 as level, (select count(*) from nodes) as nodes, (select count(*) from nodes) as mass, (select count(*) from edges) as edges
union all select 1, (select count(distinct sun) from level), (select count(*) from level), (select count(*) from pairs) where (select count(*) from nodes) > 100""")  # fmt: skip
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = coarsen.hierarchy(coarsen.seed_edges(geo(spark, sf_dir)))
    out = None
    for depth, level in enumerate(levels):
        one = level["nodes"].agg(F.lit(depth).alias("level"), F.count("*").alias("nodes"), F.sum("mass").alias("mass")).join(level["edges"].agg(F.count("*").alias("edges")), F.lit(True))
        out = one if out is None else out.unionByName(one)
    return out


# Layout


@query(with_(GEO, ARCS, NODES, NATION_LEVEL, f"coarse as (select distinct cluster as id, {uniform_sql('cluster', 1)} as x, {uniform_sql('cluster', 2)} as y from level)",
    "own as (select level.id, x, y from level join coarse on coarse.id = cluster where level.id = sun)") + """select id, round(x, 8) as x, round(y, 8) as y from own
union all select src, round(avg(x), 8), round(avg(y), 8) from arcs join own on own.id = dst where src not in (select id from own) group by src""")  # fmt: skip
def prolong_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = nation_level(spark, sf_dir)
    coarse = geo_layout(level.select(F.col("cluster").alias("id")).distinct())
    return rounded(layout.prolong_normal(level, geo(spark, sf_dir), coarse), "x", "y", digits=8)


TURN = 2 * 3.141592653589793


def between_sql(name: str, source: str, seed: int) -> str:
    key, shift = "id * 1000003 + other", "0.05 * sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y))"
    return f"""{name} as (
    select id, x + (ox - x) * part + {shift} * {uniform_sql(key, seed)} * cos({TURN} * {uniform_sql(key, seed + 1)}) as px,
        y + (oy - y) * part + {shift} * {uniform_sql(key, seed)} * sin({TURN} * {uniform_sql(key, seed + 1)}) as py from {source})"""


PROLONGED = with_(*SOLAR_PARTS, f"""level as materialized ({SOLAR_ROWS}),
spots as (select sun, {uniform_sql('cluster', 1)} as x, {uniform_sql('cluster', 2)} as y from (select sun, row_number() over (order by sun) - 1 as cluster from level where id = sun)),
own as (select id, l.sun, kind, dist, x, y from level l join spots s on s.sun = l.sun where id <> l.sun),
ways as (
    select o.id, b.sun as other, o.x, o.y, s.x as ox, s.y as oy, case when a.w + o.dist + b.dist > 0 then o.dist / (a.w + o.dist + b.dist) else 0 end as part
    from arcs a join own o on o.id = a.src join level b on b.id = a.dst join spots s on s.sun = b.sun where o.sun <> b.sun)""",
    between_sql("on_ways", "ways", 29), f"""early as (
    select o.*, coalesce(mx, x + dist * cos({TURN} * {uniform_sql('o.id', 31)})) as ox, coalesce(my, y + dist * sin({TURN} * {uniform_sql('o.id', 31)})) as oy
    from own o left join (select id, avg(px) as mx, avg(py) as my from on_ways group by id) m on m.id = o.id),
beside as (
    select a.id, b.id as other, a.x, a.y, b.ox, b.oy, a.dist, w, sqrt((b.ox - a.x) * (b.ox - a.x) + (b.oy - a.y) * (b.oy - a.y)) as way
    from arcs join early a on a.id = src join early b on b.id = dst where a.sun = b.sun and a.kind <> 3 and b.kind <> 3 and b.id < a.id),
siblings as (select *, case when way > 0 then (dist + (way - dist - w) / 2) / way else 0.5 end as part from beside)""",
    between_sql("by_siblings", "siblings", 32), """first as (
    select e.id, sun, kind, dist, coalesce(mx, ox) as ox, coalesce(my, oy) as oy
    from early e left join (select id, avg(px) as mx, avg(py) as my from (from on_ways union all from by_siblings) group by id) m on m.id = e.id where kind <> 3),
by_moon as (
    select a.id, b.id as other, a.x, a.y, b.ox, b.oy, a.dist, b.dist as far, w, sqrt((b.ox - a.x) * (b.ox - a.x) + (b.oy - a.y) * (b.oy - a.y)) as way
    from arcs join early a on a.id = src join first b on b.id = dst where a.sun = b.sun and a.kind = 3 and b.kind = 4),
along as (select *, case when far > 0 then dist / far else 0 end as part from by_moon),
apart as (select *, case when way > 0 then (dist + (way - dist - w) / 2) / way else 0.5 end as part from by_moon)""",
    between_sql("on_along", "along", 34), between_sql("on_apart", "apart", 36), """late as (
    select e.id, coalesce(mx, ox) as x, coalesce(my, oy) as y
    from early e left join (select id, avg(px) as mx, avg(py) as my from (from on_ways union all from on_along union all from on_apart) group by id) m on m.id = e.id where kind = 3)""")  # fmt: skip


@query(PROLONGED + "select sun as id, round(x, 6) as x, round(y, 6) as y from spots union all select id, round(ox, 6), round(oy, 6) from first union all select id, round(x, 6), round(y, 6) from late")
def prolong_solar(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    level = saved(coarsen.numbered(coarsen.solar(edges)))
    return rounded(layout.prolong_solar(level, edges, geo_layout(level.select(F.col("cluster").alias("id")).distinct())), "x", "y")


GRADIENT = with_(GEO, ARCS, NODES, geo_layout_sql(), """pairs as (
    select src, dst, 0 as far from arcs union all select src, 1000 + (src * 31 + dst * 17) % 100, 1 from arcs where src <> 1000 + (src * 31 + dst * 17) % 100),
placed as (
    select src, dst, far, a.x - b.x as dx, a.y - b.y as dy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2
    from pairs join layout a on a.id = src join layout b on b.id = dst),
forced as (select *, case when far = 0 then -2 / (1 + d2) else 2 * 0.01 / ((0.1 + d2) * (1 + d2)) end as f from placed),
steps as (select src, dst, greatest(-1, least(1, f * dx)) * 0.5 as dx, greatest(-1, least(1, f * dy)) * 0.5 as dy from forced),
total as (select id, sum(dx) as dx, sum(dy) as dy from (select src as id, dx, dy from steps union all select dst, -dx, -dy from steps) group by id)""")


@query(GRADIENT + "select layout.id, round(x + coalesce(dx, 0), 8) as x, round(y + coalesce(dy, 0), 8) as y from layout left join total on layout.id = total.id")
def sgd_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch over all arcs, each with one vertex that repels."""
    edges = geo(spark, sf_dir)
    arcs, spots = graph.arcs(edges).select("src", "dst"), geo_layout(graph.vertices(edges))
    far = arcs.select("src", (1000 + (F.col("src") * 31 + F.col("dst") * 17) % 100).alias("dst")).where("src <> dst")
    pull = layout.gradients(arcs, spots, layout.attraction(F.col("d2")), 0.5)
    push = layout.gradients(far, spots, layout.repulsion(F.col("d2"), 0.01), 0.5)
    return rounded(layout.moved(spots, pull.unionByName(push)), "x", "y", digits=8)


DRAWN = with_(GEO, ARCS, NODES, geo_layout_sql(), CUMULATIVE, f"""arc_parts as (select src, dst, sum(w) over (order by src * 10000000 + dst) as top, w as weight, sum(w) over () as total from arcs),
drawn as (select i as draw, src, dst from (select i, {uniform_sql('i', 17)} as u from range(0, 200) r(i)) join arc_parts on u >= (top - weight) / total and u < top / total),
others as (select i // 5 as draw, id from (select i, {uniform_sql('i', 18)} as u from range(0, 1000) r(i)) join parts on u >= (top - weight) / total and u < top / total),
pairs as (select src, dst, 0 as far from drawn union all select src, id, 1 from others join drawn on drawn.draw = others.draw where id <> src and id <> dst),
placed as (
    select src, dst, far, a.x - b.x as dx, a.y - b.y as dy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2
    from pairs join layout a on a.id = src join layout b on b.id = dst),
forced as (select *, case when far = 0 then -2 / (1 + d2) else 2 * 0.01 / ((0.1 + d2) * (1 + d2)) end as f from placed),
steps as (select src, dst, greatest(-1, least(1, f * dx)) * 0.5 as dx, greatest(-1, least(1, f * dy)) * 0.5 as dy from forced),
total as (select id, sum(dx) as dx, sum(dy) as dy from (select src as id, dx, dy from steps union all select dst, -dx, -dy from steps) group by id)""")  # fmt: skip


@query(DRAWN + "select layout.id, round(x + coalesce(dx, 0), 8) as x, round(y + coalesce(dy, 0), 8) as y from layout left join total on layout.id = total.id")
def sgd_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch of weighted draws by joins, as on graphs that do not fit one task."""
    edges = geo(spark, sf_dir)
    arcs = saved(graph.arcs(edges))
    arc_table = similarity.cumulative(arcs.withColumn("key", F.col("src") * 10_000_000 + F.col("dst")), "key", "w")
    moved = layout.epoch(geo_layout(graph.vertices(edges)), arc_table, similarity.cumulative(similarity.sampling_weights(arcs)), 200, 0, 0.5)
    return rounded(moved, "x", "y", digits=8)


@query()
def layout_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.checked(layout.layout(geo(spark, sf_dir))), "x", "y")


@query()
def layout_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattiq.plans.pipelines import Options, vectors_to_layout

    return rounded(vectors_to_layout(vectors(spark, sf_dir), Options(knn_type="largevis", perplexity=5.0)), "x", "y")


# Partitions


def kmeans_sql(k: int, rounds: int) -> str:
    out = [f"c0 as materialized (select row_number() over (order by id) - 1 as cluster, v as centre from (select * from vectors order by id limit {k}))"]
    for r in range(1, rounds + 1):
        out.append(f"""a{r} as materialized (
    select id, arg_min(cluster, (d2, cluster)) as cluster from (select id, cluster, {distance_sql('v', 'centre')} as d2 from vectors, c{r - 1}) group by id),
m{r} as (select cluster, dim, avg(x) as m, count(*) as n from (select a.cluster, unnest(range(0, len(v))) as dim, unnest(v) as x from vectors join a{r} a using (id)) group by cluster, dim),
c{r} as materialized (
    select c.cluster, case when coalesce(max(n), 0) > 1 then list(m order by dim) else any_value(centre) end as centre
    from c{r - 1} c left join m{r} m on m.cluster = c.cluster group by c.cluster)""")
    return ",\n".join(out)


@query(with_(VECTORS, kmeans_sql(10, 3)) + "select id, cast(cluster as int) as cluster from a3")
def kmeans_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.kmeans(vectors(spark, sf_dir), 10, rounds=3, threshold=-1)[0]


def quad_sql(depth: int, capacity: int) -> str:
    out = ["""q0 as materialized (select id, x, y, cx, cy, wx, wy, '' as cell from layout, (
    select avg(x) as cx, avg(y) as cy, greatest(max(x) - avg(x), avg(x) - min(x)) + 1e-5 as wx, greatest(max(y) - avg(y), avg(y) - min(y)) + 1e-5 as wy from layout))"""]
    for r in range(1, depth + 1):
        out.append(f"""q{r} as materialized (
    select id, x, y, case when n > {capacity} then cx + case when x >= cx then 1 else -1 end * wx / 2 else cx end as cx,
        case when n > {capacity} then cy + case when y >= cy then 1 else -1 end * wy / 2 else cy end as cy,
        case when n > {capacity} then wx / 2 else wx end as wx, case when n > {capacity} then wy / 2 else wy end as wy,
        case when n > {capacity} then cell || cast(case when x >= cx then 1 else 0 end + case when y >= cy then 2 else 0 end as varchar) else cell end as cell
    from (select *, count(*) over (partition by cell) as n from q{r - 1}))""")
    return ",\n".join([*out, f"cells as (select id, x, y, cell from q{depth})"])


QUAD = with_(VECTORS, VECTOR_LAYOUT, quad_sql(8, 50))


@query(QUAD + "select id, cell from cells")
def quad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.quad_cells(vector_layout(spark, sf_dir), 50, 8).select("id", "cell")


@query(QUAD + "select cell, count(*) as n, round(avg(x), 8) as x, round(avg(y), 8) as y, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from cells group by cell")
def cell_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partition.centres_of_mass(partition.quad_cells(vector_layout(spark, sf_dir), 50, 8)), "x", "y", digits=8)


@query(QUAD + "select id, dense_rank() over (order by cell) as cluster from cells")
def cell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.numbered_cells(partition.quad_cells(vector_layout(spark, sf_dir), 50, 8))


@query(with_(VECTORS, VECTOR_LAYOUT, quad_sql(8, 50), knn_sql(10), """pairs as (select distinct least(id, nbr) as u, greatest(id, nbr) as v from knn),
linked as (select a.cell, 2 * count(*) as linked from pairs join cells a on a.id = u join cells b on b.id = v and b.cell = a.cell group by a.cell),
sizes as (select cell, count(*) as n from cells group by cell)""") + "select s.cell, n, coalesce(linked, 0) as linked, case when n > 1 then coalesce(linked, 0) / (n * (n - 1)) else 0.0 end as share from sizes s left join linked l on l.cell = s.cell")  # fmt: skip
def cell_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.locality(partition.quad_cells(vector_layout(spark, sf_dir), 50, 8), knn.exact(vectors(spark, sf_dir), 10))


@query(with_(VECTORS, VECTOR_LAYOUT, quad_sql(8, 50), knn_sql(10), """inside as materialized (
    select distinct k.id as src, k.nbr as dst from knn k join cells a on a.id = k.id join cells b on b.id = k.nbr and b.cell = a.cell),
both_ways as materialized (select src, dst from inside union select dst, src from inside),
reached as (select id as src, id from cells union select r.src, b.dst from reached r join both_ways b on b.src = r.id)""", recursive=True) + "select src as id, min(id) as component from reached group by src")  # fmt: skip
def cell_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = knn.prefix_edges(knn.exact(vectors(spark, sf_dir), 10), 10)
    return partition.parts_in_cells(partition.quad_cells(vector_layout(spark, sf_dir), 50, 8), edges)


@query(with_(GEO, NODES, geo_layout_sql(), NATION_LEVEL) + f"select layout.id, round(x + {uniform_sql('cluster', 5)}, 8) as x, round(y - {uniform_sql('cluster', 5)}, 8) as y from layout join level on level.id = layout.id")
def moved_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = nation_level(spark, sf_dir)
    offsets = level.select("cluster").distinct().select("cluster", uniform("cluster", 5).alias("dx"), (-uniform("cluster", 5)).alias("dy"))
    return rounded(partition.moved_clusters(geo_layout(graph.vertices(geo(spark, sf_dir))), level, offsets), "x", "y", digits=8)


# Export and monitoring

LENGTHS = """long as (select u, v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as length from edges join layout a on a.id = u join layout b on b.id = v),
scaled as (select *, (length - (select min(length) from long)) / greatest(0.1, (select max(length) - min(length) from long)) as t from long),
stops as (select *, greatest(0, least(7, cast(floor(t * 8) as int))) as i, t * 8 - greatest(0, least(7, cast(floor(t * 8) as int))) as f from scaled)"""


def colour_sql(name: str, stops: list[float]) -> str:
    return f"round({stops}[i + 1] + ({stops}[i + 2] - {stops}[i + 1]) * f, 6) as {name}"


@query(with_(GEO, NODES, geo_layout_sql(), LENGTHS) + "select u, v, round(length, 6) as length, round(t, 6) as scaled, " + ", ".join(colour_sql(n, [s[i] for s in reversed(export.JET)]) for i, n in enumerate(("red", "green", "blue"))) + " from stops")
def edge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    made = export.coloured(edges, geo_layout(graph.vertices(edges)))
    return rounded(made, "length", "scaled", "red", "green", "blue").select("u", "v", "length", "scaled", "red", "green", "blue")


@query(with_(GEO, NODES, geo_layout_sql(), "e as (select min(x) as x0, min(y) as y0, greatest(max(x) - min(x), max(y) - min(y)) as s from layout)") + "select id, round((x - x0) / s, 8) as x, round((y - y0) / s, 8) as y from layout, e")
def layout_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.plot_normal(geo_layout(graph.vertices(geo(spark, sf_dir)))), "x", "y", digits=8)


SERVICE = "e as (select (avg(x) + avg(y)) / 2 as m, max(greatest(x, y)) as top from layout), normal as (select id, (x - m) / (top - m) as x, (y - m) / (top - m) as y from layout, e)"


@query(with_(GEO, NODES, geo_layout_sql(), SERVICE) + "select id, round(x, 8) as x, round(y, 8) as y from normal")
def service_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.service_normal(geo_layout(graph.vertices(geo(spark, sf_dir)))), "x", "y", digits=8)


@query(with_(GEO, NODES, geo_layout_sql(), SERVICE) + """select u, v, round(a.x, 8) as source_x, round(a.y, 8) as source_y, round(b.x, 8) as target_x, round(b.y, 8) as target_y
from edges join normal a on a.id = u join normal b on b.id = v""")
def service_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    return rounded(export.links(edges, geo_layout(graph.vertices(edges))), "source_x", "source_y", "target_x", "target_y", digits=8)


@query(with_(PART_SUPP) + f"select u, v, w from edges where u <> v and {uniform_sql('u * 1000003 + v', 23)} < 0.5")
def sampled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier that keeps one edge in two."""
    return export.sampled_edges(part_supp(spark, sf_dir), ((10, 1.0), (None, 0.5)))


@query("""with s as (select event_type, event_id // 250 as step, sum(value) as value from events group by event_type, event_id // 250),
a as (select *, avg(value) over (partition by event_type order by step rows between 4 preceding and current row) as average from s),
r as (select *, average / lag(average) over (partition by event_type order by step) as ratio from a)
select event_type, step, round(average, 6) as average, round(ratio, 8) as ratio, coalesce(ratio > 0.96 and ratio < 0.99, false) as settled from r""")
def moving_avg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("event_id") / 250).alias("step")).agg(F.sum("value").alias("value"))
    made = convergence.moving_average(series, "step", "value", ["event_type"])
    return rounded(rounded(made, "average"), "ratio", digits=8).select("event_type", "step", "average", "ratio", "settled")


@query(with_(GEO, NODES, geo_layout_sql(1, "a"), geo_layout_sql(3, "b")) + "select round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) as moved from a join b on a.id = b.id")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.vertices(geo(spark, sf_dir))
    return rounded(convergence.displacement(geo_layout(nodes), geo_layout(nodes, 3)), "moved")
