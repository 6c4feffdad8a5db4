"""The queries of the reference's own operators, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.functions import measures as M
from sortwell.functions import paths as P
from sortwell.functions import vectors as V
from sortwell.operators import dedup, evaluate, report, split
from sortwell.operators.edges import cosine_edges, hamming_edges
from sortwell.operators.grids import grid_components, gridded, two_class_threshold, windowed_spread
from sortwell.operators.grouping import leader_groups, merge_components, merge_single_pass, numbered_groups, vector_leaders
from sortwell.operators.index import with_position
from sortwell.oracles import ORACLES
from sortwell.plans.detect import detect_groups, keyed, kept_items, led
from sortwell.session import evenly, scratch, settle, table
from sortwell.sources import versions
from sortwell.sources.files import FORM_DEFAULTS, Settings

RATIO = 0.75


def items(spark: SparkSession, sf_dir: str, label: str = "source") -> DataFrame:
    """Documents as items: a column is the label, their order by id the position."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(F.col(label).alias("label"), "doc_id", "n_chars", V.file_hash(F.col("text")).alias("file_hash"))
    rows = with_position(settle(narrow, "narrow"), "label", [F.col("doc_id")])  # dealing by ranges samples its input, so it is written first
    return rows.withColumns({
        "path": F.concat("label", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".JPG")), "quality": F.least(F.lit(1.0), F.col("n_chars") / 10000.0),
        "sharpness": F.pmod("n_chars", F.lit(1000)) / 1000.0, "resolution": F.pmod("doc_id", F.lit(97)) / 97.0,
        "split_in": F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train"),
    })


def features(spark: SparkSession, sf_dir: str, label: str = "source") -> DataFrame:
    """Items with their token vector and its average hash, written once."""
    docs = evenly(table(spark, sf_dir, "documents").select("doc_id", label, "text", "n_chars"))
    vectors = V.with_token_vector(docs.select(F.col(label).alias("label"), "doc_id", "n_chars", V.file_hash(F.col("text")).alias("file_hash"), "text"))
    rows = with_position(settle(vectors, "vectors"), "label", [F.col("doc_id")])
    rows = rows.withColumn("phash", V.average_hash(F.col("v"))).withColumn("quality", F.least(F.lit(1.0), F.col("n_chars") / 10000.0))
    return settle(rows, "features")


# inventory, names and display


def label_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("label"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train").alias("split"))
    return report.label_inventory(docs)


def counters_pct(spark, sf_dir):
    return report.counters(table(spark, sf_dir, "documents").select(F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train").alias("split")))


def name_truncate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.shortened(F.col("p_name")).alias("short_name"))


def name_sort(spark, sf_dir):
    """Files of a label by lower-cased name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"), F.concat(F.when(F.col("doc_id") % 2 == 0, "IMG").otherwise("img"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("file_name"))
    return with_position(docs, "label", [F.lower("file_name"), F.col("doc_id")], "place").select("label", "file_name", "place")


def path_parse(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in ("JPG", "png", "txt", "TIFF", "webp", "gif")])
    path = F.concat(F.lit("/data/train/"), F.col("source"), F.lit("/img."), F.col("doc_id").cast("string"), F.lit("."), F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    name = P.base_name(F.col("path"))
    return rows.select(
        "doc_id", name.alias("file_name"), P.parent_name(F.col("path")).alias("label"), P.suffix(name).alias("suffix"), P.stem(name).alias("stem"), P.has_suffix(name).alias("in_inventory"), P.has_suffix(name, P.SORTER_SUFFIXES).alias("in_sorter"),
        P.numbered(name, F.col("doc_id") % 3).alias("numbered"), P.tagged(F.lit("train"), F.col("path")).alias("payload"), P.untagged(P.tagged(F.lit("test"), F.col("path"))).alias("dropped"), F.col("path").contains("train").alias("from_train"),
    )


def text_lines(spark, sf_dir):
    """Lines of a page's text without those that start with a tag."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(P.without_lines(F.col("html"), "<")).alias("left_chars"))


def progress_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), F.col("event_type")).alias("line"))


def config_defaults(spark, sf_dir):
    """A JSON object per event over the form's defaults."""
    got = F.from_json("props", "k int, train_ratio double")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(got["k"], F.lit(FORM_DEFAULTS["hash_threshold"])).alias("hash_threshold"), F.coalesce(got["train_ratio"], F.lit(FORM_DEFAULTS["train_ratio"])).alias("train_ratio"), F.lit(FORM_DEFAULTS["similarity_threshold"]).alias("near_duplicate_threshold"))


def settings_merge(spark, sf_dir):
    """The properties of an event as a map over a map of defaults, entry by entry."""
    base = F.create_map(F.lit("k"), F.lit(0), F.lit("folds"), F.lit(FORM_DEFAULTS["cross_validation_folds"]))
    got = M.merged_map(base, F.from_json("props", "map<string,int>"))
    return table(spark, sf_dir, "events").select("event_id", got["k"].alias("k"), got["folds"].alias("folds"), F.size(got).alias("n"))


def price_histogram(spark, sf_dir):
    """Line items by return flag in ten bins of quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", M.fixed_bin(F.col("l_quantity"), 0, 50, 10).alias("bin"))
    return li.groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("n"))


# hashes, vectors, edges, groups


def hash_groups(column, spark, sf_dir):
    src = items(spark, sf_dir, "lang") if column == "file_hash" else features(spark, sf_dir, "lang")
    return dedup.key_groups(src, column).select("label", "hash", "n", "group_no", "idx")


def hamming_pairs(spark, sf_dir):
    return hamming_edges(features(spark, sf_dir))


def rounded(sim: str = "sim"):
    """Six places as SQL rounds a double above 0: the product with a million, to the nearest whole number, halves up.

    ``floor`` does so without a decimal for each row.
    """
    return F.floor(F.col(sim) * 1e6 + 0.5) / 1e6


def cosine_pairs(threshold, spark, sf_dir):
    return cosine_edges(features(spark, sf_dir), threshold).withColumn("sim", rounded())


def embedding_pairs(spark, sf_dir):
    """Cosine pairs of the embeddings of a label, at a threshold that random vectors reach."""
    rows = with_position(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label"), "label", [F.col("vec_id")])
    return cosine_edges(rows, 0.35).withColumn("sim", rounded())


def baskets(spark, sf_dir):
    """Orders as counts of their parts in 256 buckets, which are sparse; their priority is the label."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.pmod("l_partkey", F.lit(256)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = lines.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label")).join(counts, "o_orderkey")
    rows = with_position(settle(orders, "baskets"), "label", [F.col("o_orderkey")])
    return rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("double")))


def basket_pairs(spark, sf_dir):
    """Orders of a priority with a cosine over 0.9, by the tuples of parts that they share."""
    return cosine_edges(settle(baskets(spark, sf_dir).select("label", "idx", "v"), "baskets"), 0.9).withColumn("sim", rounded())


def leaders(threshold, spark, sf_dir):
    f = features(spark, sf_dir)
    return leader_groups(hamming_edges(f)) if threshold is None else vector_leaders(f, {"near": threshold}).drop("level")


def level_groups(spark, sf_dir):
    """Leader groups of the near, variation and perceptual levels, numbered in this order."""
    f = features(spark, sf_dir)
    parts = vector_leaders(f, {"near": 0.95, "variation": 0.85}).withColumnRenamed("leader", "lead").union(led(leader_groups(hamming_edges(f)), "perceptual"))
    return f, settle(numbered_groups(parts, ["near", "variation", "perceptual"]), "groups")


def merged(how, spark, sf_dir):
    """A merged group is named by its first row; two of them may share it, so the number of its rows is told too."""
    rows = settle(how(level_groups(spark, sf_dir)[1]), "merged")
    heads = rows.groupBy("label", "group_no").agg(F.min("idx").alias("head"), F.count(F.lit(1)).alias("n"))
    return rows.join(heads, ["label", "group_no"]).select("label", "head", "n", "idx")


def detect_all_levels(spark, sf_dir):
    rows = settle(detect_groups(features(spark, sf_dir), Settings()), "detected")
    heads = rows.groupBy("label", "group_no").agg(F.min("idx").alias("head"), F.count(F.lit(1)).alias("n"))
    return rows.join(heads, ["label", "group_no"]).select("label", "head", "n", "idx")


# keeping the best


def keep_best(spark, sf_dir):
    rows = settle(items(spark, sf_dir, "lang"), "items")
    return dedup.best_of_groups(dedup.key_groups(rows, "file_hash"), rows)


def unique_dataset(spark, sf_dir):
    f, groups = level_groups(spark, sf_dir)
    return dedup.unique_items(f, merge_single_pass(groups)).select("label", "idx", "doc_id")


def unique_keeping_near(spark, sf_dir):
    """What is left when near duplicates are told from exact ones and kept."""
    f = features(spark, sf_dir)
    settings = Settings(keep_near_duplicates=True)
    return kept_items(f, settle(detect_groups(f, settings, levels="intended"), "groups"), settings).select("label", "doc_id", "uidx")


def index_remap(spark, sf_dir):
    """Groups by near vectors in the positions that are left after exact copies are gone."""
    f = features(spark, sf_dir)
    unique = with_position(dedup.unique_items(f, dedup.key_groups(f, "file_hash")), "label", [F.col("idx")], "uidx")
    near = numbered_groups(led(vector_leaders(f, {"near": 0.85}), "near"), ["near"])
    return dedup.remapped_groups(near, unique).select("label", "group_no", "idx")


def best_image_score(spark, sf_dir):
    """Line items of an order as the images of a group."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("idx"), (F.col("l_quantity") / 50.0).alias("quality_score"), (F.col("l_extendedprice") / 100.0).alias("sharpness"), F.col("l_extendedprice").alias("resolution"),
        (F.col("l_tax") * 2.0).alias("edge_density"), (F.col("l_discount") * 10.0).alias("color_richness"), (F.col("l_quantity") / 100.0).alias("exposure_quality"), (F.col("l_quantity") * 5.0).alias("brightness"), F.col("l_quantity").alias("contrast"), (F.col("l_discount") * 4.0).alias("noise_quality"),
    )
    best = dedup.weighted_best(rows, "group")
    return best.select(F.col("group").alias("group_id"), "best", F.round("score", 9).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


# measures


def quality_composite(spark, sf_dir):
    """The composite score of raw measures taken from line items, and its mean by flag."""
    li = table(spark, sf_dir, "lineitem")
    price, quantity, discount, tax = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "discount", "tax"))
    score = M.composite_score(price, quantity * 5.0, quantity, discount * 100.0, price * 100.0, tax, discount, tax)
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("avg_score"), F.round(F.max(score), 6).alias("max_score"))


def vector_histograms(spark, sf_dir):
    """Entropy, exposure and spread of each document's token histogram."""
    docs = V.with_token_vector(evenly(table(spark, sf_dir, "documents").select("doc_id", "text")))
    p = docs.withColumn("p", V.share_of_sum(F.col("v")))
    part = lambda a, n: V.total(F.slice("p", a + 1, n))
    mean = V.total(F.col("v")) / 64.0
    var = V.bound(mean, lambda m: V.total(F.transform("v", lambda x: (x - m) * (x - m)))) / 64.0
    exposure = F.greatest(F.lit(0.0), part(12, 38) - 2.0 * (part(0, 3) + part(61, 3)))
    return p.select("doc_id", F.round(V.entropy(F.col("p")), 6).alias("entropy"), F.round(exposure, 6).alias("exposure"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"), F.round(V.norm(V.normalised(F.col("v"))), 6).alias("unit"))


def classify_content(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        M.content_type(F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 50.0), F.col("l_discount") * 10.0, F.when(F.col("l_linenumber") < 6, F.col("l_linenumber"))).alias("content_type"), "l_quantity"
    )
    return rows.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


# splits


def split_by_quality(spark, sf_dir):
    return split.split_by_quality(items(spark, sf_dir), RATIO).select("label", "idx", "split")


def component_groups(threshold, spark, sf_dir):
    f = features(spark, sf_dir)
    pairs = numbered_groups(led(vector_leaders(f, {"near": threshold}), "near").union(keyed(dedup.key_groups(f, "file_hash"), "file")), ["near", "file"])
    merged_ = settle(merge_components(pairs), "components")
    heads = merged_.groupBy("label", "group_no").agg(F.min("idx").alias("head"))
    return f, merged_.join(heads, ["label", "group_no"]).select("label", F.col("head").alias("group_no"), "idx")


def group_split(threshold, content, spark, sf_dir):
    f, groups = component_groups(threshold, spark, sf_dir)
    rows = f.withColumns({"content_type": F.when(F.pmod("doc_id", F.lit(3)) == 0, "complex").otherwise("simple"), "completeness_score": F.pmod("doc_id", F.lit(11)) / 11.0, "complexity_score": F.pmod("doc_id", F.lit(13)) / 13.0})
    return split.smart_split(rows, groups, RATIO, content=content).select("label", "idx", "split")


def verify_cross_split(spark, sf_dir):
    """Conflicts of the sides that files have come with."""
    return split.cross_split_conflicts(features(spark, sf_dir, "lang").withColumn("split", F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of a label go, the best stays, and the rest is split by quality."""
    rows = settle(items(spark, sf_dir), "items")
    unique = dedup.unique_items(rows, dedup.key_groups(rows, "file_hash"))
    return split.split_by_quality(unique, RATIO).select("label", "doc_id", "split")


def kfold_assign(spark, sf_dir):
    return evaluate.with_folds(items(spark, sf_dir), 5).select("label", "idx", "fold")


def kfold_metrics(spark, sf_dir):
    rows = settle(items(spark, sf_dir), "items")
    groups = dedup.key_groups(rows, "file_hash").select("label", "group_no").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n_groups"))
    got = evaluate.kfold_metrics(rows, groups)
    return got.select("label", *[F.round(c, 9).alias(c) for c in got.columns if c != "label"])


def config_ranking(spark, sf_dir):
    """Configurations by overall score, each with the groups that its own near threshold finds."""
    return evaluate.evaluate_configs(features(spark, sf_dir)).select("label", "config", "overall_score", "place")


def config_comparison(spark, sf_dir):
    """The table behind the comparison: all metrics of each configuration and label."""
    rows = evaluate.evaluate_configs(features(spark, sf_dir))
    return rows.select("label", "config", "place", *[F.round(c, 9).alias(c) for c in ("overall_score", *evaluate.METRICS)])


# reports


def split_report(spark, sf_dir):
    rows = report.split_report(split.split_by_quality(items(spark, sf_dir), RATIO))
    return rows.select("label", "split", "count", *[F.round(c, 6).alias(c) for c in rows.columns if c.startswith("avg_")])


def ratio_report(spark, sf_dir):
    rows = report.ratio_report(split.split_by_quality(items(spark, sf_dir), RATIO), RATIO)
    return rows.select("label", "train", "test", F.round("train_ratio", 6).alias("train_ratio"), F.round("deviation", 6).alias("deviation"))


def group_report(spark, sf_dir):
    rows = settle(items(spark, sf_dir, "lang"), "items")
    return report.group_report(dedup.key_groups(rows, "file_hash"), rows).select("label", "group_id", "size", "idx", "path")


def groups_per_side(spark, sf_dir):
    rows = settle(items(spark, sf_dir, "lang"), "items")
    return report.groups_per_side(dedup.key_groups(rows, "file_hash"), split.split_by_quality(rows, RATIO))


def manifest_of(spark, sf_dir):
    rows = items(spark, sf_dir).select("label", F.col("split_in").alias("split"), F.concat("split_in", F.lit("/"), "label").alias("folder"), F.concat(F.lit("img"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(".JPG")).alias("file_name"), "file_hash", "doc_id")
    return report.copy_manifest(rows, "folder", order="doc_id")


def copy_manifest(spark, sf_dir):
    return manifest_of(spark, sf_dir).select("folder", "doc_id", "target_name")


def output_recount(spark, sf_dir):
    """Files of the manifest against the items that should be in the output."""
    return report.recount(manifest_of(spark, sf_dir), items(spark, sf_dir).select(F.col("split_in").alias("split")))


def name_lookup(spark, sf_dir):
    """Where each name of a label is found, in train first."""
    rows = settle(items(spark, sf_dir).select("label", F.col("split_in").alias("split"), F.concat(F.lit("img"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(".JPG")).alias("file_name"), "path"), "files")
    asked = rows.select("label").distinct().withColumn("file_name", F.explode(F.array(*[F.lit(f"img{k}.JPG") for k in range(9)])))
    return report.lookup_names(asked, rows)


def move_one(spark, sf_dir):
    """The first document of each source sent to the other side, and the counts after it."""
    rows = items(spark, sf_dir).select("label", "idx", F.col("split_in").alias("split"), F.when(F.col("idx") == 0, "first").otherwise("other").alias("path"))
    return report.moved(rows, "first").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def move_report(spark, sf_dir):
    """A line for each file whose side a split by quality changes."""
    rows = settle(items(spark, sf_dir), "items")
    before = rows.select("label", "path", F.col("split_in").alias("split"), P.base_name(F.col("path")).alias("file_name"))
    return report.move_lines(before, split.split_by_quality(rows, RATIO).select("label", "path", "split"))


def label_results(spark, sf_dir):
    rows = settle(items(spark, sf_dir), "items")
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("total_images"))
    groups = dedup.key_groups(rows, "file_hash").select("label", "group_no").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("duplicates_removed"))
    sides = split.split_by_quality(rows, RATIO).groupBy("label").agg(*[F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_images") for s in ("train", "test")])
    # a label without test files counts as failed
    return n.join(groups, "label", "left").na.fill(0).join(sides, "label").withColumn("total_images", F.when(F.col("test_images") > 0, F.col("total_images")))


def run_totals(spark, sf_dir):
    return report.run_totals(label_results(spark, sf_dir))


def run_lines(spark, sf_dir):
    return report.run_lines(label_results(spark, sf_dir))


def run_report(spark, sf_dir):
    """The summary of a run that keeps near duplicates, label by label, with what was written."""
    f = features(spark, sf_dir).withColumns({"sharpness": F.pmod("n_chars", F.lit(1000)) / 1000.0, "resolution": F.pmod("doc_id", F.lit(97)) / 97.0})
    exact = settle(dedup.key_groups(f, "file_hash"), "exact")
    near = vector_leaders(f, {"near": 0.95}).drop("level").withColumnRenamed("leader", "group_no")
    unique = settle(dedup.unique_items(f, exact), "unique")
    dealt = settle(split.split_by_quality(unique, RATIO), "splits")
    written = dealt.where(F.pmod("doc_id", F.lit(10)) != 0).select("label", "split")
    got = report.run_report(f, unique, exact, near, dealt, written, {"remove_exact_duplicates": True, "keep_near_duplicates": True, "train_ratio": RATIO, "embedding_method": "tokens"})
    flat = lambda c: F.round(f"split_results.{c}", 6).alias(c.replace(".", "_"))
    return got.select(
        "label", "processing_summary.*", "verification.*", *[F.col(f"split_results.{s}.{c}").alias(f"{s}_{c}") for s in ("train", "test") for c in ("count", "files_copied")],
        *[flat(f"{s}.avg_{c}") for s in ("train", "test") for c in ("quality", "sharpness", "resolution")], "settings.train_ratio", "settings.embedding_method",
    )


# images: an embedding's numbers as the gray levels of a raster


def rasters(spark, sf_dir):
    single = lambda n: F.lit(float(n)).cast("float")  # noqa: E731  # in single precision, as the embedding is; a whole number would make it double
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x * single(300) + single(128)).cast("double")))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", gray.alias("gray"), F.transform(gray, lambda x: x.cast("double")).alias("g"))


def image_levels(spark, sf_dir):
    """Mean, spread and exposure of the gray levels."""
    g = F.col("g")
    return rasters(spark, sf_dir).select("vec_id", F.round(M.mean(g), 4).alias("brightness"), F.round(M.spread(g), 4).alias("contrast"), F.round(M.exposure(F.col("gray")), 6).alias("exposure"), F.size("gray").cast("long").alias("pixels"))



def class_threshold(spark, sf_dir):
    """The price, in thousands, that parts each flag's lines into two classes."""
    bins = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_extendedprice") / 1000.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return two_class_threshold(bins, "l_returnflag").withColumn("between", F.round("between", 6))


def grid_texture(spark, sf_dir):
    """Spread in windows of 4 x 4 of each raster of 8 x 8."""
    return windowed_spread(gridded(rasters(spark, sf_dir), "vec_id", "gray", 8), "vec_id", 4, 2).withColumn("spread", F.round("spread", 6))


def grid_parts(spark, sf_dir):
    """Connected bright parts of more than three cells of each raster."""
    return grid_components(gridded(rasters(spark, sf_dir), "vec_id", "gray", 8), "vec_id", "x > 140", 3)


def rotated_groups(spark, sf_dir):
    """Groups by a hash that turned copies share; every seventh row has a copy that is turned."""
    f = features(spark, sf_dir).select("label", "idx", "phash")
    turned = f.where("idx % 7 = 0").select("label", (F.col("idx") + 1_000_000).alias("idx"), F.element_at(V.rotations(F.col("phash")), (F.col("idx") % 3 + 2).cast("int")).alias("phash"))
    rows = f.unionByName(turned).withColumn("turned", V.canonical_rotation(F.col("phash")))
    return dedup.key_groups(settle(rows, "turned"), "turned").select("label", "hash", "n", "group_no", "idx")


def image_measures(spark, sf_dir):
    """Hash, composite quality and content type of each raster."""
    g = F.col("g")
    steps = V.total(F.transform(F.sequence(F.lit(2), F.size(g)), lambda i: F.abs(F.element_at(g, i) - F.element_at(g, i - 1)))) / (F.size(g) - 1)
    rows = rasters(spark, sf_dir).select("vec_id", "gray", V.average_hash(g).alias("phash"), M.mean(g).alias("m"), M.spread(g).alias("s"), steps.alias("steps"), F.size("gray").alias("n"))
    nothing = F.lit(0.0)
    quality = M.composite_score(F.col("steps") * 10, F.col("m"), F.col("s"), nothing, F.col("n"), nothing, nothing, M.exposure(F.col("gray")))
    kind = M.content_type(F.col("s") / 60.0, F.lit(None).cast("double"), F.lit(None).cast("int"))
    return rows.select("vec_id", "phash", F.round(quality, 6).alias("quality"), F.round("steps", 4).alias("steps"), kind.alias("content_type"))


def ssim_neighbours(spark, sf_dir):
    """Likeness of each raster and the one before it in its label: structural, by cosine, and by differing hash bits."""
    rows = settle(with_position(rasters(spark, sf_dir), "label", [F.col("vec_id")]), "rasters")
    before = rows.select(F.col("label").alias("l"), (F.col("idx") + 1).alias("at"), F.col("g").alias("h"))
    pairs = rows.join(before, F.col("label").eqNullSafe(F.col("l")) & (F.col("idx") == F.col("at")))
    g, h = F.col("g"), F.col("h")
    return pairs.select("vec_id", F.round(M.ssim(g, h), 6).alias("ssim"), F.round(V.cosine(g, h), 6).alias("cosine"), V.hamming(V.average_hash(g), V.average_hash(h)).alias("bits"))



def manifest_versions(spark, sf_dir):
    """Versions of a store side by side: all labels, two of them dealt anew, back to the first, one file moved."""
    root = scratch(spark, "store")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("label"), "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    dealt = lambda rows, n: rows.withColumn("split", F.when(F.pmod("doc_id", F.lit(n)) == 0, "test").otherwise("train"))
    versions.replace_labels(dealt(docs, 5), root)
    versions.replace_labels(dealt(docs.where("label IN ('src1', 'src12')"), 2), root)
    versions.undo(spark, root)
    versions.move_file(spark, root, docs.agg(F.min_by("path", "doc_id")).first()[0])
    return versions.history(spark, root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "flagship_dedup_split": flagship,
        "label_inventory": label_inventory,
        "counters_pct": counters_pct,
        "name_truncate": name_truncate,
        "name_sort": name_sort,
        "path_parse": path_parse,
        "text_lines": text_lines,
        "progress_log": progress_log,
        "config_defaults": config_defaults,
        "settings_merge": settings_merge,
        "price_histogram": price_histogram,
        "file_hash_groups": partial(hash_groups, "file_hash"),
        "phash_groups": partial(hash_groups, "phash"),
        "hamming_pairs": hamming_pairs,
        "cosine_pairs_near": partial(cosine_pairs, 0.95),
        "cosine_pairs_variation": partial(cosine_pairs, 0.85),
        "cosine_pairs_semantic": partial(cosine_pairs, 0.80),
        "embedding_pairs": embedding_pairs,
        "basket_pairs": basket_pairs,
        "leader_groups_near": partial(leaders, 0.95),
        "leader_groups_variation": partial(leaders, 0.85),
        "leader_groups_semantic": partial(leaders, 0.80),
        "leader_groups_perceptual": partial(leaders, None),
        "merge_single_pass": partial(merged, merge_single_pass),
        "merge_components": partial(merged, merge_components),
        "detect_all_levels": detect_all_levels,
        "keep_best": keep_best,
        "unique_dataset": unique_dataset,
        "unique_keeping_near": unique_keeping_near,
        "index_remap": index_remap,
        "best_image_score": best_image_score,
        "quality_composite": quality_composite,
        "vector_histograms": vector_histograms,
        "classify_content": classify_content,
        "split_by_quality": split_by_quality,
        "split_group_aware": partial(group_split, 0.95, None),
        "split_rebalance": partial(group_split, 0.80, None),
        "split_content_compat": partial(group_split, 0.95, "compat"),
        "split_content_intended": partial(group_split, 0.95, "intended"),
        "verify_cross_split": verify_cross_split,
        "kfold_assign": kfold_assign,
        "kfold_metrics": kfold_metrics,
        "config_ranking": config_ranking,
        "config_comparison": config_comparison,
        "split_report": split_report,
        "ratio_report": ratio_report,
        "group_report": group_report,
        "groups_per_side": groups_per_side,
        "manifest_versions": manifest_versions,
        "copy_manifest": copy_manifest,
        "output_recount": output_recount,
        "name_lookup": name_lookup,
        "move_one": move_one,
        "move_report": move_report,
        "run_totals": run_totals,
        "run_lines": run_lines,
        "run_report": run_report,
        "class_threshold": class_threshold,
        "grid_texture": grid_texture,
        "grid_parts": grid_parts,
        "rotated_groups": rotated_groups,
        "image_measures": image_measures,
        "image_levels": image_levels,
        "ssim_neighbours": ssim_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
