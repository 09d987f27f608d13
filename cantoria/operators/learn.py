"""Features, clustering, multi-label ordinal models, topics, attributions.

TF-IDF and class-TF-IDF are long-form SQL aggregations (term tables), so they stay exact and oracle-checkable;
Spark ML (KMeans, RandomForest / OneVsRest-GBT, PCA) runs on ``VectorUDT`` built from array columns at the
boundary. Models are fitted on review-sized sets and applied to the whole corpus with ``transform``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantoria.fixed import DIMS, N_CLUSTERS, SEED

TEXTS = 512                    # M1: texts whose tokens a task holds beside their Arrow batch
COUNT = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

# ------------------------------------------------------------------------------------------------ M1 TF-IDF
def _slices(batches):
    """Arrow batches cut to ``TEXTS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def term_counts(tokens_df: DataFrame, doc: str, term: str = "term") -> DataFrame:
    """(doc, _counts): the distinct terms of each row's array of tokens with their number, in the row; rows without a token
    are left out. Nothing is shuffled."""
    tokens = F.col(term) if isinstance(tokens_df.schema[term].dataType, T.ArrayType) else F.array(term)
    rows = tokens_df.select(doc, F.array_compact(tokens).alias("_tokens")).where(F.size("_tokens") > 0)
    schema = T.StructType([tokens_df.schema[doc], T.StructField("_counts", T.ArrayType(COUNT))])

    def count(batches):
        for batch in _slices(batches):
            lists = batch.column(1)
            flat = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            many = len(flat.dictionary)
            found, n = np.unique(row * many + flat.indices.to_numpy(), return_counts=True)
            pairs = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(found % many)), pa.array(n)], ["term", "tf"])
            starts = np.searchsorted(found // many, np.arange(len(lists) + 1)).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts), pairs)], names=schema.names)

    return rows.mapInArrow(count, schema)


def tfidf(tokens_df: DataFrame, doc: str, term: str = "term", max_features: int = 5000) -> DataFrame:
    """M1 (long form): the ``max_features`` most frequent terms of the corpus (ties by term); raw counts times
    smooth idf ln((1 + n) / (1 + df)) + 1; rows scaled to unit L2 norm. Output (doc, term, weight).

    ``term`` is an array of tokens (a row a text) or one token (a row a token). Counts stay in the row of their text, so only
    the vocabulary is shuffled and a norm is taken where the counts are. Rows that share a document, or have none, are
    counted together by (document, term) instead."""
    from cantoria.operators.density import _written
    # read by three branches (repeated documents, vocabulary, weights): written once into the shared checkpoint folder, in columns
    counts = _written(term_counts(tokens_df, doc, term))
    sizes = counts.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    again = _written(sizes.where((F.col("_n") > 1) | F.col(doc).isNull()).select(F.col(doc).alias("_doc")))
    same = F.col(doc).eqNullSafe(F.col("_doc"))
    shared = not again.isEmpty()
    single = counts.join(again, same, "left_anti") if shared else counts
    long = single.select(doc, F.inline("_counts"))
    if shared:
        merged = _written(counts.join(again, same, "left_semi").select(doc, F.inline("_counts")).groupBy(doc, "term").agg(F.sum("tf").alias("tf")))
        # a text without a document counts in the vocabulary, but has no row of weights
        together = merged.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.collect_list(F.struct("term", "tf")).alias("_counts"))
        single, long = single.unionByName(together), long.unionByName(merged)
    n_docs = sizes.count()
    vocab = (long.groupBy("term").agg(F.sum("tf").alias("_cf"), F.count(F.lit(1)).alias("_df"))
             .orderBy(F.desc("_cf"), F.asc("term")).limit(max_features)
             .select("term", (F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("_df"))) + 1.0).alias("_idf")).collect())    # <= max_features rows
    words, idf = [r["term"] for r in vocab], np.array([r["_idf"] for r in vocab], dtype=float)
    schema = T.StructType([tokens_df.schema[doc], T.StructField(term, T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches):
        known = pa.array(words, pa.string())
        for batch in _slices(batches):
            lists = batch.column(1)
            pairs = lists.flatten()
            place = pc.index_in(pc.struct_field(pairs, "term"), value_set=known)
            kept = place.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[kept]
            place = place.drop_null().to_numpy()
            w = pc.struct_field(pairs, "tf").to_numpy()[kept] * idf[place]
            norm = np.sqrt(np.bincount(row, w * w, len(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), known.take(pa.array(place)), pa.array(w / norm[row])], names=schema.names)

    return single.select(doc, "_counts").mapInArrow(weigh, schema)


def tfidf_vectors(docs: DataFrame, tokens_col: str, max_features: int = 5000, out: str = "features") -> DataFrame:
    """M1 as ML features: CountVectorizer (top terms) -> IDF, rescaled to the smooth ``idf + 1`` form ->
    L2 normaliser; sparse vectors stay native (JVM) end to end. The counts are written once, without the tokens: the
    weights, a model fitted on them and its predictions read them, and no text is tokenised again."""
    from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer
    from pyspark.ml.linalg import Vectors
    cv = CountVectorizer(inputCol=tokens_col, outputCol="_tf", vocabSize=max_features).fit(docs)
    from cantoria.session import cut_lineage
    tf = cut_lineage(cv.transform(docs).drop(tokens_col))
    idf = IDF(inputCol="_tf", outputCol="_idf0").fit(tf)
    scale = Vectors.dense([x + 1.0 for x in idf.idf.toArray()])   # vocabulary-sized, bounded by max_features
    w = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_w").transform(tf)
    return Normalizer(inputCol="_w", outputCol=out, p=2.0).transform(w).drop("_tf", "_w")


# ------------------------------------------------------------------------------------------------ M2 / A2 / F6
def cluster(df: DataFrame, k: int = N_CLUSTERS, seed: int = SEED, features: str = "features") -> tuple[DataFrame, object]:
    """M2: k-means (k=15, seed 42) -> ``cluster`` column."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    return model.transform(df), model


def cluster_profile(long: DataFrame, assign: DataFrame, doc: str, term: str = "term", top: int = 7,
                    drop: list[int] | None = None) -> DataFrame:
    """A2: per cluster its size and ``top`` heaviest mean TF-IDF terms, with kept/dropped status."""
    size = assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("tamano"))
    mean = (long.join(assign.select(doc, "cluster"), doc).groupBy("cluster", term).agg(F.sum("weight").alias("_s"))
            .join(size, "cluster").withColumn("peso", F.col("_s") / F.col("tamano")))
    w = Window.partitionBy("cluster").orderBy(F.desc("peso"), term)
    tops = mean.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    terms = tops.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", term))),
                                                                 lambda x: x[term]), ", ").alias("terminos"))
    out = size.join(terms, "cluster", "left")
    return out.withColumn("estado", F.when(F.col("cluster").isin(drop or []), F.lit("descartado")).otherwise(F.lit("conservado")))


def drop_clusters(df: DataFrame, ids: list[int], col: str = "cluster") -> DataFrame:
    """F6."""
    return df.where(~F.col(col).isin(ids)) if ids else df


# ------------------------------------------------------------------------------------------------ M9 / M11
def balanced_weights(df: DataFrame, y: str, by: str | None = None, few: bool = False) -> DataFrame:
    """M9: n / (k * n_class) per row (k = number of classes present), within each ``by`` when given. ``few``: the classes
    are those of a classifier, so their table is broadcast and no row is shuffled by its class."""
    keys = [by] if by else []
    cnt = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_nc"))     # one row per class
    over = Window.partitionBy(*keys)
    w = cnt.select(*keys, y, (F.sum("_nc").over(over) / (F.count(F.lit(1)).over(over) * F.col("_nc"))).alias("peso"))
    return df.join(F.broadcast(w) if few else w, [*keys, y])


def label_map(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """Present classes and their index 0..k-1 in ascending order (one row per class)."""
    keys = [by] if by else []
    return df.select(*keys, y).distinct().withColumn("indice", (F.row_number().over(Window.partitionBy(*keys).orderBy(y)) - 1).cast("int"))


def label_index(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """M11 forward: adds the index of the row's class."""
    return df.join(label_map(df, y, by), [*([by] if by else []), y])


def label_decode(df: DataFrame, classes: DataFrame, y: str, by: str | None = None, index: str = "indice") -> DataFrame:
    """M11 back: adds the class of an index, from the table that ``label_map`` gave."""
    return df.join(classes.withColumnRenamed("indice", index), [*([by] if by else []), index])


# ------------------------------------------------------------------------------------------------ M10 / M12
def train_multilabel(df: DataFrame, vec: str, label_cols: list[str], weight: str | None = None,
                     algo: str = "rf", seed: int = SEED, trees: int | None = None, depth: int = 4,
                     balanced: bool = True, validation: float = 0.1) -> dict[str, PipelineModel]:
    """One independent classifier per dimension on the same features, rows weighted by class (M9) unless a
    ``weight`` column is named or ``balanced`` is off.

    ``rf``: random forest of 100 trees. ``gbt``: Spark's boosted trees are binary, so OneVsRest of at most 1,500 trees
    (step 0.01) each; a fraction ``validation`` of the rows, drawn by hash of the vector, stops the boosting once they
    no longer gain. ``trees`` overrides the number of trees."""
    from cantoria.session import cut_lineage
    held = F.pmod(F.xxhash64(F.col(vec), F.lit(seed)), F.lit(1000)) < int(1000 * validation)
    # every fit reads the rows several times: only what training needs, written once
    base = cut_lineage(df.select(array_to_vector(vec).alias("features"), held.alias("_held"), *dict.fromkeys([*label_cols, *([weight] if weight else [])])))
    models = {}
    for c in label_cols:
        d = base.withColumn("label", F.col(c).cast("double"))
        w = weight
        if w is None and balanced:
            d, w = balanced_weights(d, "label", few=True), "peso"
        if algo == "gbt":
            gbt = GBTClassifier(maxDepth=depth, maxIter=trees or 1500, stepSize=0.01, subsamplingRate=0.8, seed=seed,
                                validationIndicatorCol="_held", validationTol=1e-4)
            clf = OneVsRest(classifier=gbt, featuresCol="features", labelCol="label", predictionCol=f"pred_{c}")
        else:
            clf = RandomForestClassifier(numTrees=trees or 100, maxDepth=depth, seed=seed, featuresCol="features",
                                         labelCol="label", predictionCol=f"pred_{c}",
                                         probabilityCol=f"prob_{c}", rawPredictionCol=f"raw_{c}")
        if w:
            clf.setWeightCol(w)
        models[c] = Pipeline(stages=[clf]).fit(d)
    return models


def accuracy_report(scored: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: rows, plain accuracy and balanced accuracy (mean recall of the classes present)."""
    per = scored.groupBy(F.col(truth).alias("_y")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(truth) == F.col(prediction)).alias("_hit"))
    return per.agg(F.sum("_n").alias("filas"), (F.sum("_hit") / F.sum("_n")).alias("exactitud"),
                   F.avg(F.col("_hit") / F.col("_n")).alias("exactitud_balanceada"))


def score_units(df: DataFrame, vec: str, models: dict[str, PipelineModel], prefix: str = "intensidad_") -> DataFrame:
    """One shared feature column, six chained ``transform`` calls, integer predictions."""
    out = df.withColumn("features", array_to_vector(vec))
    for c, m in models.items():
        out = m.transform(out)
        dim = c.split("_")[-1]
        drops = [x for x in out.columns if x.startswith(("prob_", "raw_"))]
        out = out.withColumn(f"{prefix}{dim}", F.col(f"pred_{c}").cast("int")).drop(f"pred_{c}", *drops)
    return out.drop("features")


# ------------------------------------------------------------------------------------------------ M13 / M14
def project(df: DataFrame, vec: str, k: int = 3) -> DataFrame:
    """M13 (re-aimed): linear PCA to k coordinates, distributed (k columns ``c1..ck``)."""
    d = df.withColumn("_f", array_to_vector(vec))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(d)
    p = model.transform(d).withColumn("_pa", vector_to_array("_p"))
    return p.select(*df.columns, *[F.col("_pa")[i].alias(f"c{i + 1}") for i in range(k)])


def topic_model(df: DataFrame, vec: str, k: int = 8, min_size: int = 15, seed: int = SEED,
                dims: int = 5, far: float = 0.98) -> DataFrame:
    """M14 (re-aimed): vectors -> PCA(5) -> k-means. Rows farther from their centre than the ``far`` quantile of their
    cluster, and clusters smaller than ``min_size``, become topic -1."""
    from cantoria.session import cut_lineage
    df = cut_lineage(df)          # PCA, k-means, the limits and the result all read the rows
    p = project(df, vec, dims)
    feats = p.withColumn("_f", F.array(*[F.col(f"c{i + 1}") for i in range(dims)]))
    d = feats.withColumn("features", array_to_vector("_f"))
    m = KMeans(k=k, seed=seed, predictionCol="_t").fit(d)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m.clusterCenters()])       # k x dims numbers
    own = F.element_at(centres, F.col("_t") + 1)
    gap = F.aggregate(F.zip_with("_f", own, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    t = m.transform(d).withColumn("_d", gap)
    limits = t.groupBy("_t").agg(F.count(F.lit(1)).alias("_sz"), F.percentile_approx("_d", far, 10000).alias("_far"))
    t = t.join(F.broadcast(limits), "_t")                                                          # k rows
    inside = (F.col("_sz") >= min_size) & (F.col("_d") <= F.col("_far"))
    return t.select(*df.columns, F.when(inside, F.col("_t")).otherwise(F.lit(-1)).alias("topic"))


def density_topic_model(df: DataFrame, id_col: str, vec: str, min_size: int = 15, min_samples: int = 5, dims: int = 5) -> DataFrame:
    """Vectors -> PCA(5) -> density clusters (``density.density_topics``); adds ``topic``, -1 for noise. Ids must
    be unique."""
    from cantoria.operators.density import density_topics
    from cantoria.session import cut_lineage
    df = cut_lineage(df)          # PCA, the clusters and the result all read the rows
    low = project(df.select(id_col, vec), vec, dims).select(id_col, F.array(*[F.col(f"c{i + 1}") for i in range(dims)]).alias("_low"))
    return df.join(density_topics(low, id_col, "_low", min_size, min_samples), id_col)


# ------------------------------------------------------------------------------------------------ M15 / M16
def class_tfidf(grams: DataFrame, topic: str, term: str = "ngram", top: int = 10) -> DataFrame:
    """Per topic, tf * ln(1 + A / f) where tf = term count in the topic, f = term count over all topics,
    A = average number of words per topic; the ``top`` terms per topic (ties by term)."""
    from cantoria.session import written
    tf = written(grams.groupBy(topic, term).agg(F.count(F.lit(1)).alias("tf")), "terms")        # read by two branches
    per_topic = tf.groupBy(topic).agg(F.sum("tf").alias("_wt"))
    a = per_topic.agg(F.avg("_wt").alias("_A"))
    from cantoria.operators.stats import _one_row_join
    # a term has one row a topic at most, so its rows meet in one exchange; a null term has no score
    own = tf.where(F.col(term).isNotNull()).withColumn("_f", F.sum("tf").over(Window.partitionBy(term)))
    s = _one_row_join(own, a).withColumn("score", F.col("tf") * F.log(1 + F.col("_A") / F.col("_f")))
    w = Window.partitionBy(topic).orderBy(F.desc("score"), term)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(topic, term, "score", "rank")


def topic_info(docs: DataFrame, grams: DataFrame, topic: str = "topic", term: str = "ngram", top: int = 10, named: int = 4) -> DataFrame:
    """Per topic its documents, its ``top`` terms and a name of the topic and its first terms."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.col(term).alias("t"))))                # <= top terms
    terms = class_tfidf(grams, topic, term, top).groupBy(topic).agg(F.transform(ranked, lambda x: x["t"]).alias("_terms"))
    size = docs.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("_", F.col(topic).cast("string"), F.slice("_terms", 1, named))
    return size.join(terms, topic, "left").select(topic, "n", name.alias("nombre"), F.array_join("_terms", ", ").alias("terminos"))


def topic_trend(docs: DataFrame, grams: DataFrame, topic: str = "topic", bin_col: str = "bin", term: str = "ngram", top: int = 5) -> DataFrame:
    """Per topic and time bin its documents and ``top`` terms (M15 with every (topic, bin) as a class)."""
    cell = F.struct(topic, bin_col).alias("_cell")
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.col(term).alias("t"))))
    terms = (class_tfidf(grams.select(cell, term), "_cell", term, top).groupBy("_cell")
             .agg(F.array_join(F.transform(ranked, lambda x: x["t"]), ", ").alias("terminos")))
    size = docs.select(cell).groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    return size.join(terms, "_cell", "left").select(F.col(f"_cell.{topic}").alias(topic), F.col(f"_cell.{bin_col}").alias(bin_col), "n", "terminos")


def time_bins(year: str, lo: int, hi: int, bins: int = 20):
    """Equal-width year bins over [lo, hi], the top edge in the last bin."""
    return F.least(F.floor((F.col(year) - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(bins))


# ------------------------------------------------------------------------------------------------ M17
def token_attribution(df: DataFrame, id_col: str, text_col: str, score_fn, mode: str = "runs") -> DataFrame:
    """M17 (re-aimed, leave-one-token-out): for every token occurrence, score(full text) - score(text without
    that occurrence), scaled per text by the maximum absolute value. ``score_fn(Column) -> Column`` must be a
    Spark expression (e.g. a lexicon scorer or a model wrapped in a pandas UDF)."""
    from cantoria.functions.text import tokens
    t = df.select(id_col, tokens(text_col, mode).alias("_tok"))
    occ = t.select(id_col, "_tok", F.posexplode("_tok").alias("pos", "token"))
    masked = F.array_join(F.filter("_tok", lambda x, i: i != F.col("pos")), " ")
    full = F.array_join("_tok", " ")
    occ = occ.withColumn("contrib", score_fn(full).cast("double") - score_fn(masked).cast("double"))
    w = Window.partitionBy(id_col)
    mx = F.max(F.abs("contrib")).over(w)
    return occ.select(id_col, "pos", "token", F.when(mx > 0, F.col("contrib") / mx).otherwise(0.0).alias("aporte"))


__all__ = ["tfidf", "tfidf_vectors", "cluster", "cluster_profile", "drop_clusters", "balanced_weights", "label_index", "label_map", "label_decode",
           "train_multilabel", "score_units", "project", "topic_model", "density_topic_model", "class_tfidf", "topic_info", "topic_trend", "accuracy_report", "time_bins",
           "token_attribution", "DIMS", "math"]
