"""Queries over the driver's tables: an order is a record, its lines are molecules, an event is evidence, an embedding a vector with a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions import columns as C
from crucible.functions.tables import settled
from crucible.operators import evidence as E
from crucible.operators import losses as L
from crucible.operators import quality as Q
from crucible.operators import records as R
from crucible.operators import segments as S
from crucible.operators import similarity as T
from crucible.operators import training as TR
from crucible.operators import validate as V
from crucible.operators.digests import digest_tree
from crucible.operators.pivots import pivot_neighbours
from crucible.operators.encoder import Config, encode_molecules, encode_records, example_of, new_weights, trace_records
from crucible.plans import analyse as A
from crucible.plans import formats
from crucible.plans import model as M
from crucible.sources.sinks import checksum, histogram

#: Stand-ins for direction codes; other event types have none.
EVENT_CODES = {"click": "left_to_right", "view": "right_to_left", "purchase": "reversible", "signup": "undefined"}
IGNORED = ["Brand#1", "Brand#2"]
#: Components of an embedding.
DIM = 64


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def members(spark, d) -> DataFrame:
    """One row per line: a molecule of its order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("record_id"), F.when(F.col("l_returnflag") == "R", "reactant").otherwise("product").alias("side"),
        F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("p_brand").alias("compound_id"), F.col("p_name").alias("original"), F.col("p_type").alias("canonical"),
        F.when(F.col("p_size") % 7 == 0, "unsanitized").otherwise("sanitized").alias("status"), F.col("p_size"),
    )


def by_record(spark, d) -> DataFrame:
    """members, all of a record in one partition: its participants, the record and joins on it then need no other shuffle."""
    return members(spark, d).repartition("record_id")


def coefficients(spark, d) -> DataFrame:
    """(record_id, participants) with one participant for each compound and side."""
    m = by_record(spark, d)
    sign = F.when(F.col("side") == "reactant", -1.0).otherwise(1.0)
    parts = m.groupBy("record_id", "side", "compound_id").agg((F.count(F.lit(1)) * F.first(sign)).alias("coefficient"))
    return parts.withColumn("compartment", F.lit(None).cast("string")).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("compound_id", "coefficient", "compartment"))).alias("participants"))


def keyed(spark, d) -> DataFrame:
    return R.with_keys(coefficients(spark, d), IGNORED)


def resolved(spark, d) -> DataFrame:
    refs = F.create_map(F.lit("cust"), F.array((F.col("o_custkey") % 3).cast("string")))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.array(F.col("o_orderpriority")).alias("labels"), refs.alias("xrefs"))
    # Keys are made once: the rule reads them for the groups and for the records; what they are made of stays behind.
    return R.resolve_duplicates(settled(keyed(spark, d).drop("participants").join(orders, "record_id"), "keyed"), number=F.col("record_id"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def labelled(spark, d) -> DataFrame:
    """Dotted labels: some rows have two, every fifth none."""
    token = lambda x: F.concat_ws(".", x % 2, x % 5, x)
    other = (F.col("label") + 1) % 10
    lists = F.when(F.col("vec_id") % 5 == 4, F.lit(None).cast("array<string>")).when(F.col("vec_id") % 7 == 0, F.array(token(F.col("label")), token(other))).otherwise(F.array(token(F.col("label"))))
    return vectors(spark, d).select("vec_id", lists.alias("ec"))


def neighbours(spark, d, k=10) -> DataFrame:
    return T.exact_neighbours(vectors(spark, d), k, "vec_id", "embedding")


def evidence(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    db = F.concat(F.lit("db"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    return E.direction_evidence(events.withColumn("db", db), "user_id", "event_type", "event_id", database="db", codes=EVENT_CODES)


def masters(spark, d) -> DataFrame:
    """Customers in threes: members of one canonical record."""
    return table(spark, d, "customer").select((F.col("c_custkey") - F.col("c_custkey") % 3).alias("canonical_id"), F.col("c_custkey").alias("user_id"))


def variants(spark, d) -> DataFrame:
    return E.direction_variants(masters(spark, d), evidence(spark, d), "user_id")


def views(spark, d) -> DataFrame:
    """Batches of eight vectors with two views: the first and the last half."""
    v = F.col("embedding").cast("array<double>")
    return vectors(spark, d).select((F.col("vec_id") - F.col("vec_id") % 8).alias("batch"), "vec_id", F.slice(v, 1, DIM // 2).alias("a"), F.slice(v, DIM // 2 + 1, DIM // 2).alias("b"))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# queries, in the order of the inventory


def scan_project_cast(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 100000")
    return o.select(C.prefixed("ORD", "o_orderkey").alias("order_id"), C.numeric_suffix(C.prefixed("ORD", "o_orderkey")).alias("order_number"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).cast("int").alias("priority"))


def filter_prefix_exists(spark, d):
    per = members(spark, d).groupBy("record_id").agg(F.collect_list("compound_id").alias("c"))
    return per.filter(F.exists("c", lambda x: x.startswith("Brand#1"))).select("record_id", F.size("c").alias("n"))


def enum_recode(spark, d):
    e = table(spark, d, "events").select("event_id", C.recode("event_type", EVENT_CODES).alias("direction")).filter("direction IS NOT NULL")
    return e.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def participants_agg(spark, d):
    p = R.participants(members(spark, d))
    return p.select("record_id", "side", "compound_id", "canonical", "coefficient", "original", "status", "missing")


def positional_zip(spark, d):
    words = lambda c: F.split(c, " ")
    pairs = table(spark, d, "documents").select("doc_id", F.posexplode(R.positional_zip(words(F.col("text")), F.split("source", "c"))).alias("pos", "p"))
    return pairs.select("doc_id", "pos", F.col("p.left").alias("left_part"), F.col("p.right").alias("right_part"))


def change_log(spark, d):
    return R.changes(members(spark, d)).groupBy("compound_id", "confidence").agg(F.count(F.lit(1)).alias("n"))


def coef_reduce_gcd(spark, d):
    r = coefficients(spark, d).select("record_id", F.explode(C.reduced_coefficients(F.col("participants"))).alias("p"))
    return r.select("record_id", "p.compound_id", "p.coefficient")


def canonical_keys(spark, d):
    return keyed(spark, d).select("record_id", "strict_key")


def loose_keys(spark, d):
    return keyed(spark, d).select("record_id", "loose_key")


def dedup_winners(spark, d):
    m = R.merged(settled(resolved(spark, d), "resolved"), number=F.col("record_id"))
    return m.select("record_id", "group_size", F.array_join("equivalent_ids", ";").alias("equivalent_ids"), F.array_join("labels", ";").alias("labels"))


def dedup_conflicts(spark, d):
    c = resolved(spark, d).filter("dedup_status = 'kept_conflict'")
    return c.select("record_id", "strict_key", "group_size")


def dedup_idmap(spark, d):
    sources = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    return R.id_map(resolved(spark, d), sources)


def dedup_stats(spark, d):
    return R.dedup_stats(resolved(spark, d), xrefs="xrefs")


def loose_candidates(spark, d):
    kept = resolved(spark, d).filter("record_id = canonical_id")
    c = R.loose_candidates(kept, number=F.col("record_id"))
    return c.select("loose_key", F.array_join("record_ids", ";").alias("record_ids"), "candidate_count", "action")


def published(spark, d) -> DataFrame:
    """Kept orders in the published layout: four numbers from an order's, structures of its parts, labels of all but every third."""
    key = F.col("record_id")
    numbers = [(key * 10 + i).alias(n) for i, n in enumerate(formats.VARIANTS)]
    all_of = settled(resolved(spark, d).withColumn("labels", F.when(key % 3 != 0, F.col("labels"))).select("*", *numbers), "resolved")
    kept = R.merged(all_of, number=key).join(formats.group_facts(all_of, "1", "ORD", number=key), "canonical_id")
    parts = R.participants(by_record(spark, d).withColumn("canonical", C.recode("canonical", STRUCTURES))).withColumn("cofactor", F.when(F.col("compound_id") == "Brand#3", F.col("compound_id")))
    nested = R.nested(parts, ["side_order", "compound_id", "canonical", "coefficient", "side", "compartment", "status", "original", "cofactor"])
    more = {
        "reaction_smiles": R.text_of(F.col("participants")), "source_reaction_smiles": F.lit(None).cast("string"), "supported_directions": supported_of(key), "direction_evidence_summary_json": F.lit(None).cast("string"),
        "is_balanced": F.col("status") == "F", "element_delta": F.lit(None).cast("string"), "charge_delta": F.lit(0), "status": F.when(F.col("status") == "F", "balanced").when(F.col("status") == "O", "imbalanced").otherwise("unknown"),
    }
    return formats.records(kept.join(nested, "record_id").withColumns(more), "ORD")


def record_fields(spark, d):
    p = published(spark, d)
    return p.select(
        F.col("reaction_id").alias("record_id"), "equivalence_group_id", F.array_join("source_ids.rhea", ";").alias("source_ids"), F.array_join(F.transform("equivalent_rhea_master_ids", lambda x: x.cast("string")), ";").alias("members"),
        F.array_join(F.transform("provenance", lambda x: x["source_reaction_id"].cast("string")), ";").alias("provenance"), F.array_join("ec_numbers", ";").alias("labels"), F.col("missing_masks.ec_numbers").alias("labels_missing"),
        F.col("missing_masks.direction").alias("direction_missing"), "direction_variant_ids.reversible", F.size("participants").alias("n_participants"),
    )


def record_fields_rest(spark, d):
    """What record_fields leaves out of the record."""
    p = published(spark, d)
    shown = lambda x: F.concat_ws(",", x["compound_id"], x["original_smiles"], x["canonical_smiles"], x["smiles_sanitization_status"], x["smiles_missing"].cast("string"), F.coalesce("reaction_type", F.lit("-")), x["coefficient"].cast("int").cast("string"), x["original_coefficient"].cast("int").cast("string"), x["side"], F.coalesce(x["mapped_smiles"], x["compartment"], x["role"], F.lit("-")), F.coalesce(x["cofactor_role"], F.lit("-")), x["cofactor_missing"].cast("string"), x["compartment_missing"].cast("string"), x["role_missing"].cast("string"))
    return p.select(
        "canonical_reaction_id", "direction_variant_ids.master", "direction_variant_ids.left_to_right", "direction_variant_ids.right_to_left", F.array_join(F.transform("participants", shown), ";").alias("participants"),
        "reaction_smiles", "source_reaction_smiles", "atom_mapped_reaction_smiles", "direction", "reaction_type", F.array_join("supported_directions", ";").alias("supported_directions"), "direction_missing", "direction_evidence_summary_json",
        "is_balanced", "balance_check_status", "balance_element_delta_json", "balance_charge_delta", "balance_unknown_atom_count", "context", "external_xrefs_json", "canonical_key_sha256", "loose_key_sha256",
    )


def source_table(spark, d):
    """Every order as a source, with what became of it, in the published layout."""
    key = F.col("record_id")
    sources = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.array("o_orderpriority").alias("labels"), F.create_map(F.lit("cust"), F.array(F.col("o_custkey").cast("string"))).alias("xrefs"))
    mapping = R.id_map(resolved(spark, d), sources)
    lost = mapping.filter("canonical_id IS NULL").select(F.col("source_id").alias("record_id"), F.lit("rxn_lookup").alias("stage"), F.lit("no lines").alias("error"))
    outcomes = R.source_records(sources, mapping, lost).withColumns({n: key * 10 + i for i, n in enumerate(formats.VARIANTS)})
    out = formats.source_records(outcomes, "ORD")
    return out.withColumn("direction_variant_ids", F.concat_ws(";", "direction_variant_ids.*")).withColumn("ec_numbers", F.array_join("ec_numbers", ";"))


def variant_table(spark, d):
    """The direction variants in the published layout, with the identifiers of all members for each direction."""
    of = masters(spark, d).select("canonical_id", F.explode(F.array(*(F.struct(F.lit(x).alias("direction"), C.prefixed("CUS", F.col("user_id") * 10 + i).alias("id")) for i, x in enumerate(C.DIRECTIONS[:3], 1)))).alias("x"))
    ids = of.groupBy("canonical_id", "x.direction").agg(F.array_sort(F.collect_list("x.id")).alias("directional_ids"))
    out = formats.variants(variants(spark, d).join(ids, ["canonical_id", "direction"]))
    names = [c for c in out.columns if not c.endswith("directional_ids")]
    return out.select(*names, *(F.array_join(c, ";").alias("directional_ids") for c in out.columns if c not in names))


def coverage_full(spark, d):
    return formats.coverage(published(spark, d))


def report_counts(spark, d):
    return formats.report_counts(published(spark, d))


def corpus_index(spark, d):
    """Labels and cofactors of records as the encoder's numbers."""
    rows = M.build_corpus(published(spark, d)).rows
    return rows.select("record_id", F.array_join(F.transform("label_index", lambda x: x.cast("string")), ";").alias("label_index"), F.size(F.filter("participants", lambda p: p["cofactor_index"] > 0)).alias("n_cofactors"))


def vocab_sizes(spark, d):
    c = M.build_corpus(published(spark, d))
    return spark.createDataFrame([(k, v) for k, v in c.sizes.items()] + [("molecule", c.molecules.count() + 1)], "vocabulary string, size long")


def balance_status(spark, d):
    atoms = F.map_from_arrays(F.array(F.lit("C"), F.lit("H")), F.array(F.col("p_size").cast("long"), (F.col("p_size") % 3).cast("long")))
    m = members(spark, d).select(
        "record_id", "side", F.when(F.col("compound_id") == "Brand#25", "POLYMER:25").otherwise(F.col("compound_id")).alias("compound_id"),
        F.when(F.col("p_size") != 50, atoms).alias("atoms"), (F.col("p_size") % 2).cast("long").alias("charge"), F.when(F.col("p_size") == 49, 1).otherwise(0).alias("unknown_atoms"),
    )
    return R.balance(m).select("record_id", "is_balanced", "status", "reason", "charge_delta", "element_delta")


def field_coverage(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus", "o_orderpriority")
    m = members(spark, d).groupBy("record_id").agg(F.collect_list(F.struct("compound_id", "canonical", "p_size")).alias("participants"))
    joined = orders.join(m, "record_id")
    return R.coverage(
        joined,
        {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT", "nothing": F.lit(None).cast("boolean")},
        {"compound": lambda p: p["compound_id"] != "", "large": lambda p: p["p_size"] > 25, "economy": lambda p: p["canonical"] == "ECONOMY"},
    )


def index_values(spark, d):
    return E.index_values(table(spark, d, "events"), "user_id", "event_type").select("user_id", F.array_join("values", ";").alias("types"))


def index_xrefs(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return E.index_xrefs(e, "user_id", "event_type", "k").select("user_id", F.to_json("xrefs").alias("xrefs"))


def direction_evidence(spark, d):
    return evidence(spark, d).groupBy("user_id", "direction", "database").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_id"))


def direction_variants(spark, d):
    return variants(spark, d)


def direction_policy(spark, d):
    s = E.supported(variants(spark, d))
    return s.select("canonical_id", F.array_join("directions", ";").alias("directions"), C.direction_policy(F.col("directions")).alias("policy"))


def direction_support_stats(spark, d):
    return E.support_stats(variants(spark, d))


def failures_left_join(spark, d):
    """Customers whose segment has no supplier nation stand for sources without blob."""
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("m"), F.col("c_custkey") % 120).alias("member"))
    blobs = table(spark, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey") % 90).alias("member"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("content"))
    found, lost = R.parse_outcomes(sources, blobs)
    mapping = found.select(F.col("record_id").alias("source_id"), F.col("record_id").alias("canonical_id"), F.lit("kept").alias("status"))
    return R.source_records(sources, mapping, lost).select("record_id", "canonical_id", "included", "parse_status", "parse_error")


def semi_anti_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    seen = o.join(returned, "o_orderkey", "left_semi").withColumn("part", F.lit("seen"))
    return seen.unionByName(o.join(returned, "o_orderkey", "left_anti").withColumn("part", F.lit("held_out")))


def knn_top10(spark, d):
    return neighbours(spark, d).select(F.col("query").alias("query_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def knn_top1(spark, d):
    return neighbours(spark, d, 1).select(F.col("query").alias("query_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def knn_global_top20(spark, d):
    top = Q.global_top(neighbours(spark, d), "cosine", 20, ["query", "neighbour"])
    return top.select(F.col("query").alias("query_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def knn_pivots(spark, d):
    """As knn_top10, by cells of some 100 vectors."""
    near = pivot_neighbours(vectors(spark, d), 10, "vec_id", "embedding", cell=100)
    return near.select(F.col("query").alias("query_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def neighbour_labels(spark, d):
    lab = vectors(spark, d).select("vec_id", "label")
    n = neighbours(spark, d).join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(lab.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("b")), "neighbour")
    return n.select(F.col("query").alias("query_id"), "rank", (F.col("a") % 2 == F.col("b") % 2).alias("level1_match"), (F.col("a") == F.col("b")).alias("exact_match"))


def neighbour_table(spark, d):
    t = A.neighbour_table(neighbours(spark, d), labelled(spark, d), "vec_id", "ec")
    return t.withColumn("cosine_similarity", F.round("cosine_similarity", 6))


def retrieval_metrics(spark, d):
    m = T.retrieval_metrics(neighbours(spark, d), labelled(spark, d), "vec_id", "ec")
    return m.select("level", "k", "annotated_query_count", *r6("precision", "hit_rate", "random_precision", "random_hit_rate", "lift"))


def random_baseline(spark, d):
    tokens = T.token_rows(labelled(spark, d), "vec_id", "ec")
    return T.match_counts(tokens).select("level", F.col("id").alias("vec_id"), "matches")


def ec_tokens(spark, d):
    t = T.token_rows(labelled(spark, d), "vec_id", "ec")
    return t.select("level", F.col("id").alias("vec_id"), F.array_join("tokens", ";").alias("tokens"))


def paired_delta_ci(spark, d):
    half = vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, 16))
    second = T.exact_neighbours(half, 1, "vec_id", "embedding")
    p = T.paired_top1(neighbours(spark, d, 1), second, labelled(spark, d), "vec_id", "ec")
    return p.select("level", "annotated_query_count", *r6("first_precision", "second_precision", "delta", "low", "high"), "improved", "worsened", "unchanged")


def ablation_metrics(spark, d):
    """Metrics of the whole vectors against those of their first 16 components."""
    labels = labelled(spark, d)
    half = T.exact_neighbours(vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, 16)), 10, "vec_id", "embedding")
    c = T.compare_metrics(T.retrieval_metrics(neighbours(spark, d), labels, "vec_id", "ec"), T.retrieval_metrics(half, labels, "vec_id", "ec"))
    return c.select("level", "k", *r6("first_precision", "second_precision", "precision_delta", "first_hit_rate", "second_hit_rate", "hit_rate_delta"))


def ordered_ids_check(spark, d):
    """Identifiers of two tables, place by place: customers against themselves and against suppliers."""
    place = lambda n, key: table(spark, d, n).select(F.col(key).alias("position"), F.col(key).alias("id"))
    c = place("customer", "c_custkey")
    return V.union(V.check_same_order(c, c, "position", "id", "same"), V.check_same_order(c, place("supplier", "s_suppkey"), "position", "id", "shorter"))


def quantised(spark, d):
    """The sign of each quarter's sum: coarse enough for groups, and every component counts."""
    part = lambda i: F.aggregate(F.slice(F.col("embedding").cast("array<double>"), i * (DIM // 4) + 1, DIM // 4), F.lit(0.0), lambda a, x: a + x)
    return vectors(spark, d).select("vec_id", "label", F.array(*(F.signum(part(i)).cast("int") for i in range(4))).alias("q"))


def vector_duplicates(spark, d):
    g = Q.duplicate_groups(quantised(spark, d), "vec_id", F.array_join("q", ","))
    return g.select(F.col("key").alias("vector_key"), "group_size", "first_id")


def group_numbers(spark, d):
    g = Q.numbered_groups(Q.duplicate_groups(quantised(spark, d), "vec_id", F.array_join("q", ",")))
    return g.select("group_id", F.col("key").alias("vector_key"), "group_size", "first_id")


def dup_histogram(spark, d):
    return Q.duplicate_histogram(Q.duplicate_groups(quantised(spark, d), "vec_id", F.array_join("q", ",")))


def dup_excess(spark, d):
    return Q.duplicate_excess(quantised(spark, d), "q")


def dup_diagnosis(spark, d):
    _, _, summary = Q.diagnose(quantised(spark, d), "vec_id", F.array_join("q", ","), {"label": F.col("label"), "parity": F.col("label") % 2}, {"zero_label": F.col("label") == 0})
    return summary


def text_exact_duplicates(spark, d):
    docs = table(spark, d, "documents")
    _, groups, _ = Q.diagnose(docs, "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), {"source": F.col("source"), "lang": F.col("lang")}, {"long": F.col("n_chars") > 1000})
    return groups.select(F.col("key").alias("text_key"), "group_size", "first_id", "same_source", "same_lang", "has_long")


def shared_identity(spark, d):
    return Q.shared_identities(table(spark, d, "part"), "p_name", "p_brand")


def norm_stats(spark, d):
    s = Q.norm_stats(vectors(spark, d), "embedding")
    return s.select("row_count", "non_finite_count", *r6("norm_min", "norm_max", "norm_mean", "norm_std"))


def dim_std(spark, d):
    return Q.dimension_stats(vectors(spark, d), "embedding").select("dim", *r6("mean", "std"))


def cosine_quantiles(spark, d):
    q = Q.quantiles(neighbours(spark, d, 1), "cosine", (0.05, 0.5, 0.95, 0.99), (0.5,))
    return q.select(*r6("min", "mean", "max", "std", "p05", "p50", "p95", "p99"), "count_ge_0_5")


def pca_spectrum(spark, d):
    return Q.spectrum(vectors(spark, d), "embedding").select("component", *r6("eigenvalue", "ratio", "cumulative"))


def collapse_report(spark, d):
    return Q.collapse_report(vectors(spark, d), "vec_id", "embedding")


def segment_sum(spark, d):
    s = S.segment_sum(vectors(spark, d).withColumn("v", F.col("embedding").cast("array<double>")), "label", "v")
    return s.select("label", F.posexplode("v").alias("dim", "x")).select("label", "dim", *r6("x"))


def segment_softmax(spark, d):
    w = S.segment_softmax(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 10).alias("s")), "l_orderkey", "s")
    return w.select("l_orderkey", "l_linenumber", "l_partkey", *r6("weight"))


def segment_weighted_mean(spark, d):
    """The price in cents of an order's lines, weighed by quantity: sums of whole numbers, so their order does not matter."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("w"))
    return lines.groupBy("l_orderkey").agg(S.weighted_mean(F.col("x"), F.col("w")).alias("cents"))


def segment_counts(spark, d):
    return S.segment_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer"), "c_custkey")


def variance_loss(spark, d):
    return L.variance_loss(views(spark, d), "batch", ["a", "b"]).select("batch", *r6("loss"))


def covariance_loss(spark, d):
    return L.covariance_loss(views(spark, d), "batch", ["a", "b"]).select("batch", *r6("loss"))


def info_nce(spark, d):
    return L.info_nce(views(spark, d), "batch", "vec_id", "a", "b").select("batch", *r6("loss"))


def label_loss(spark, d):
    v = views(spark, d).withColumn("t", F.transform(F.sequence(F.lit(0), F.lit(DIM // 2 - 1)), lambda i: F.when((F.col("vec_id") % 3 != 0) & (i == F.col("vec_id") % 8), 1.0).otherwise(0.0)))
    return L.label_loss(v, "batch", "a", "t").select("batch", *r6("loss"))


def vocab_index(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"))
    return S.with_index(parts, S.vocabulary(parts, "name"), "name", "name_index").select("p_partkey", F.col("name_index").cast("long"))


def csr_pointers(spark, d):
    return S.pointers(table(spark, d, "lineitem"), "l_orderkey").select("l_orderkey", "n", F.col("begin").alias("row_begin"), F.col("end").alias("row_end"))


def cumulative_share(spark, d):
    return S.cumulative_share(table(spark, d, "part"), "p_brand", "p_size").select("position", "p_brand", *r6("share", "cumulative"))


def split_train_val(spark, d):
    return S.split(table(spark, d, "orders"), "o_orderkey", 0.1, 42)


def rank_monotone_check(spark, d):
    return Q.monotone_violations(neighbours(spark, d), "query", "rank", "cosine", 10)


def constraint_suite(spark, d):
    lines, orders, v = table(spark, d, "lineitem"), table(spark, d, "orders"), variants(spark, d)
    suite = V.Suite().rows(lines, {"quantity_positive": F.col("l_quantity") > 0, "discount_small": F.col("l_discount") <= 0.05, "known_flag": F.col("l_returnflag").isin("A", "N", "R")})
    suite.unique(orders, ["o_orderkey"], "order_unique").unique(lines, ["l_orderkey", "l_linenumber"], "line_unique")
    suite.complete(v, "canonical_id", "direction", list(C.DIRECTIONS[:3]), "three_variants")
    suite.references(lines, "l_orderkey", orders, "line_has_order", "o_orderkey").rows(orders, {"all_finished": F.col("o_orderstatus") == "F"})
    return suite.checks()


def embedding_wide(spark, d):
    return vectors(spark, d).select("vec_id", *C.wide("embedding", DIM))


def one_hot(spark, d):
    return vectors(spark, d).select("vec_id", F.array_join(F.transform(C.one_hot(F.col("label"), [0, 1, 2]), lambda x: x.cast("int").cast("string")), "").alias("hot"))


#: Structures that stand for part types; the names of types are no SMILES.
STRUCTURES = {"ECONOMY": "CCO", "STANDARD": "CC=O", "SMALL": "O", "MEDIUM": "CC(=O)O", "LARGE": "c1ccccc1O", "PROMO": "[NH4+]"}
ENCODER = Config(dim=32, steps=2, readout="attention_sum", dropout=0.0)


def supported_of(key):
    return F.filter(F.array(*(F.when(key % m == 0, F.lit(x)) for m, x in ((2, "left_to_right"), (3, "right_to_left"), (5, "reversible")))), lambda x: x.isNotNull())


def corpus(spark, d) -> DataFrame:
    """Orders as records that the encoder takes."""
    parts = R.participants(by_record(spark, d).withColumn("canonical", C.recode("canonical", STRUCTURES))).withColumn("cofactor", F.lit(None).cast("string"))
    nested = R.nested(parts, ["side_order", "compound_id", "canonical", "coefficient", "side", "cofactor", "status"])
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.array("o_orderpriority").alias("labels"))
    return nested.join(orders, "record_id").withColumn("supported_directions", supported_of(F.col("record_id")))


def encode_reactions(spark, d):
    v = encode_records(A.model_rows(corpus(spark, d)), ENCODER, new_weights(ENCODER))
    return v.select("record_id", F.size("embedding").alias("dim"), F.round(C.norm(F.col("embedding").cast("array<double>")), 4).alias("norm"))


def record_signatures(spark, d):
    rows = A.model_rows(corpus(spark, d))
    return rows.select("record_id", "direction", *(c.alias(n) for n, c in A.signatures(F.col("participants"), F.col("direction"), F.col("labels")).items()))


def encoded_signatures(spark, d):
    rows = A.model_rows(corpus(spark, d))
    key = lambda p: F.sha2(F.coalesce(p["canonical"], F.lit("*")), 256)
    return rows.select("record_id", A.encoded_signature(F.col("participants"), F.col("direction"), key).alias("signature"))


def collision_trace(spark, d):
    """Molecules and records with equal vectors, with the weights that an encoder begins with."""
    rows = settled(A.distinct_inputs(A.model_rows(corpus(spark, d)), "participants", "direction"), "inputs")
    weights = new_weights(ENCODER)
    texts = rows.select(F.explode("participants.canonical").alias("canonical")).filter("canonical IS NOT NULL")
    molecules = settled(encode_molecules(texts, "canonical", ENCODER, weights), "molecules")
    return A.collision_trace(molecules, rows, encode_records(rows, ENCODER, weights), "n_records")[1]


def train_steps(spark, d):
    """Two steps of training on all partitions: the loss of each."""
    c = M.build_corpus(published(spark, d))
    config, _ = M.untrained(c, steps=2, readout="attention_sum")
    _, losses = TR.fit_distributed(A.model_rows(c.rows).repartition(8, "record_id"), config, steps=2, size=32)
    return spark.createDataFrame(list(enumerate(losses, 1)), "step int, loss double")


def duplicate_vector_diagnosis(spark, d):
    parts = R.participants(members(spark, d).withColumn("canonical", C.recode("canonical", STRUCTURES)), by=[])
    several = Q.shared_identities(parts, "canonical", "compound_id")  # structures of all records, each compound's once
    rows = settled(A.distinct_inputs(A.model_rows(corpus(spark, d)), "participants", "direction", "labels"), "inputs")
    return A.diagnose(encode_records(rows, ENCODER, new_weights(ENCODER)), rows, several, "n_records")[2]


def molecule_collisions(spark, d):
    """A part is a chain as long as its size that ends in the group of its type; parts of one size and type are one molecule."""
    tail = C.recode(F.col("p_type"), STRUCTURES)
    texts = table(spark, d, "part").select(F.concat(F.expr("repeat('C', p_size)"), tail).alias("smiles")).filter("smiles IS NOT NULL").distinct()
    v = encode_molecules(texts, "smiles", ENCODER, new_weights(ENCODER))
    return Q.duplicate_excess(v, "vector", numeric=False)


def fusion_trace(spark, d):
    """Records of one main signature, of which none is reversible. Equal inputs are traced once, and no trace is written but those of a stage that differ."""
    rows = A.model_rows(corpus(spark, d)).withColumn("labels", F.lit(None).cast("array<string>"))  # no input of the main signature
    rows = A.distinct_inputs(rows, "participants", "direction", "labels")
    rows = settled(rows.select("record_id", "participants", "direction", "n_records", A.signatures(F.col("participants"), F.col("direction"), F.col("labels"))["main"].alias("group")), "signed")
    groups = A.without_direction(rows, "group").groupBy("group").agg(F.sum("n_records").alias("n")).filter("n > 1").select("group")
    traced = trace_records(rows.join(groups.hint("merge"), "group", "left_semi"), ENCODER, new_weights(ENCODER), carry=("group", "n_records"))
    names = ["fusion_input", "linear1", "relu", "linear2", "layernorm"]
    return Q.stage_uniqueness(traced, "group", names, "n_records").groupBy("first_collapsed").agg(F.count(F.lit(1)).alias("groups"))


def stage_ranges(spark, d):
    """Vectors of a label on the way to one value: as they are, rounded, their signs, their length in whole units."""
    v, unit = F.col("embedding").cast("array<double>"), lambda x: F.round(x, 1)
    stages = vectors(spark, d).select("label", v.alias("given"), F.transform(v, unit).alias("rounded"), F.transform(F.slice(v, 1, 4), F.signum).alias("signs"), F.array(F.size(v).cast("double")).alias("length"))
    return Q.stage_uniqueness(stages, "label", ["given", "rounded", "signs", "length"])


def input_audit(spark, d):
    return A.audit(corpus(spark, d), ENCODER, new_weights(ENCODER))


def direction_counts(spark, d):
    return A.direction_counts(corpus(spark, d))


def invariance_checks(spark, d):
    """On the first eight records in order, as the check is defined."""
    rows = [example_of(r) for r in A.model_rows(corpus(spark, d)).orderBy("record_id").limit(8).collect()]
    return spark.createDataFrame([A.invariance(rows, ENCODER, new_weights(ENCODER))])


def rows_tree(spark, d):
    return digest_tree(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), depth=2)


def rows_checksum(spark, d):
    names = ("orders", "part", "customer", "supplier")
    return spark.createDataFrame([(n, checksum(table(spark, d, n))) for n in names], "name string, checksum string")


def cosine_histogram(spark, d):
    return histogram(neighbours(spark, d, 1), "cosine", -1.0, 1.0, 40)


QUERIES = {f.__name__: f for f in (
    scan_project_cast, filter_prefix_exists, enum_recode, participants_agg, positional_zip, change_log, coef_reduce_gcd, canonical_keys, loose_keys,
    dedup_winners, dedup_conflicts, dedup_idmap, dedup_stats, loose_candidates, balance_status, field_coverage, record_fields, record_fields_rest, source_table, variant_table, coverage_full, report_counts, corpus_index, vocab_sizes, index_values, index_xrefs,
    direction_evidence, direction_variants, direction_policy, direction_support_stats, failures_left_join, semi_anti_split, knn_top10, knn_pivots, knn_top1, knn_global_top20,
    neighbour_labels, neighbour_table, retrieval_metrics, random_baseline, ec_tokens, paired_delta_ci, ablation_metrics, ordered_ids_check, vector_duplicates, group_numbers, dup_histogram, dup_excess, dup_diagnosis,
    text_exact_duplicates, shared_identity, norm_stats, dim_std, cosine_quantiles, pca_spectrum, collapse_report, segment_sum, segment_softmax, segment_counts, segment_weighted_mean,
    variance_loss, covariance_loss, info_nce, label_loss, vocab_index, csr_pointers, cumulative_share, split_train_val, rank_monotone_check,
    constraint_suite, embedding_wide, one_hot, encode_reactions, record_signatures, encoded_signatures, collision_trace, train_steps, duplicate_vector_diagnosis, molecule_collisions, fusion_trace, stage_ranges,
    input_audit, direction_counts, invariance_checks, rows_checksum, rows_tree, cosine_histogram,
)}
