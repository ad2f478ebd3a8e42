"""Registered queries of the feature, history, graph and model layers over the fixture views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import evaluation as E
from strandline.operators import features as X
from strandline.operators import graph as G
from strandline.operators import history as H
from strandline.operators import labels as L
from strandline.operators import models as M
from strandline.sources import logs, sinks
from strandline.sources.fixtures import DIVIDER, FIRST_DAY, LAST_DAY, Views
from strandline.sources.shared import shared_folder

#: Neighbours of the k-NN join, and the last day of the window in which factors are asked for.
NEIGHBOURS, LAST_TEST_DAY = 100, "2024-01-30"


class Tables(Views):
    """The intermediate tables, each a plan over the views.

    The three that everything else starts from are parsed from the logs once and kept, as merges and labels meet them again
    and again; they hold days and counts, not log lines.
    """

    @cached_property
    def _by_tag(self) -> DataFrame:
        return X.within(X.daily_clicks_by_tag(self.actions(), self.registrations()), FIRST_DAY, LAST_DAY).persist()

    @cached_property
    def _sent(self) -> DataFrame:
        return X.within(X.delivery_days(self.deliveries()), FIRST_DAY, LAST_DAY).persist()

    @cached_property
    def _loaded(self) -> DataFrame:
        return X.within(X.download_days(self.downloads()), FIRST_DAY, LAST_DAY).persist()

    def by_tag(self) -> DataFrame:
        return self._by_tag

    def sent(self) -> DataFrame:
        return self._sent

    def loaded(self) -> DataFrame:
        return self._loaded

    def period_clicks(self) -> DataFrame:
        return X.period_of_daily(X.daily_clicks(self.by_tag()), "clicks")

    def period_deliveries(self) -> DataFrame:
        return X.period_of_daily(X.daily_deliveries(self.sent()), "deliveries")

    def period_downloads(self) -> DataFrame:
        return X.period_of_rows(self.loaded().select("resumeid", "date", F.col("downcount").alias("daily_count")), "downloads")

    def series(self) -> DataFrame:
        return X.time_series(self.period_clicks(), self.period_deliveries(), self.period_downloads())

    def delivery_matches(self) -> DataFrame:
        return X.delivery_matches(self.sent(), self.resumes(), self.positions())

    def download_matches(self) -> DataFrame:
        return X.download_matches(self.loaded(), self.resumes(), self.positions())

    def merged(self, faithful: bool = True) -> DataFrame:
        return X.feature_merge(self.by_tag(), self.sent(), self.loaded(), self.series(), X.match_statistics(self.delivery_matches()), X.match_statistics(self.download_matches()), faithful)

    def active(self) -> DataFrame:
        return L.active_days(self.by_tag(), self.sent())

    def labelled(self) -> DataFrame:
        return L.labelled(self.merged(), L.label_horizon(self.active()))

    def histories(self) -> DataFrame:
        return H.history_vectors(self.by_tag(), self.sent())

    def similar(self, samples: DataFrame | None = None) -> DataFrame:
        """Match features of the resumes that have samples. These have the ids of the merge's rows, which needn't be computed again if given."""
        known = (L.valid_ids(self.merged()) if samples is None else samples).select(F.col("resume_id").alias("resumeid"))
        both = self.delivery_matches().select("resumeid").join(self.download_matches().select("resumeid").distinct(), "resumeid", "left_semi")
        return X.similar_resume_data(X.match_statistics(self.delivery_matches()), X.match_statistics(self.download_matches()), known.join(both.distinct(), "resumeid", "left_semi"))

    def weights(self) -> DataFrame:
        return G.pair_weights(G.pairs(self.actions(), self.registrations(), self.deliveries()))

    def rule_predictions(self) -> DataFrame:
        """A rule in place of a model: enough clicks or any delivery of the day predict activity."""
        rule = ((F.col("click_count") >= 2) & (F.col("delivery_count") == 0)) | (F.col("delivery_count") >= 2)
        return self.labelled().select("resume_id", "date", F.col("label").cast("int").alias("label"), rule.cast("int").alias("prediction"))

    def samples(self, extra: list[str] | None = None) -> DataFrame:
        rows = L.valid_ids(self.labelled()).withColumn("day", F.dayofyear("date"))
        return M.assemble(rows, [*X.feature_names(), *(extra or [])]).select("resume_id", "date", "day", "label", "features")

    def history_samples(self) -> DataFrame:
        rows = H.append_history(self.labelled(), self.histories())
        whole = F.concat(F.array(*[F.col(c).cast("double") for c in X.feature_names()]), F.col("history").cast("array<double>"))
        return rows.withColumn("features", M.array_to_vector(whole)).select(F.col("resumeid").alias("resume_id"), "date", F.dayofyear("date").alias("day"), "label", "features")

    def base_samples(self) -> DataFrame:
        rows = L.valid_ids(self.labelled()).withColumn("day", F.dayofyear("date"))
        return M.assemble(rows, X.feature_names()[:12]).select("resume_id", "date", "day", "label", "features")

    def base_history_samples(self) -> DataFrame:
        rows = self.history_samples()
        both = L.slice_features(F.slice(M.vector_to_array("features"), 1, 42), F.slice(M.vector_to_array("features"), 43, 10), "BH")
        return rows.withColumn("features", M.array_to_vector(both))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _text(col: str):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias(col)


def _trained(fit, samples=None, balance=True):
    """A query that trains up to the divider, and evaluates by date from it on."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        rows = M.few_tasks((samples or Tables.samples)(t))
        train, test = L.date_split(rows, DIVIDER)
        train = E.undersample(train, ["resume_id", "date"]) if balance else train
        return E.evaluate(fit(train)(test).select("date", F.col("label").cast("int").alias("label"), "prediction"))

    return query


def _plain_sgd(train: DataFrame) -> M.Model:
    return M.Descent(step=1.0, penalty=0.0).model(train)


def _time_logistic(train: DataFrame, gamma: float = 0.0) -> M.Model:
    """The day weighs samples and is no feature."""
    return M.Descent(gamma=gamma).model(E.time_weights(train), weight="weight")


def _match_logistic(time: bool, leaves: bool = False):
    """Neighbour-regularised models: on features, or on the leaves of a forest, which then encode the neighbours too.

    Samples, match features and the samples with their neighbours are stored, so that no plan holds another.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        samples = M.few_tasks(t.samples())
        train, test = L.date_split(samples, DIVIDER)
        near = G.nearest_in_day(M.stored(t.similar(samples)), X.feature_names()[12:])
        if leaves:
            encode = M.leaf_encoder(E.undersample(train, ["resume_id", "date"]))
            train, test = encode(train), encode(test)
        vectors = train.select(F.col("resume_id").alias("neighbour"), "date", M.sparse().alias("x"))
        how = "inner" if time else "left"
        found = near.join(vectors, ["neighbour", "date"], how).groupBy("resumeid", "date").agg(F.collect_list("x").alias("neighbours"))
        train = M.stored(train.join(found.withColumnRenamed("resumeid", "resume_id"), ["resume_id", "date"], how))
        train = E.undersample(train, ["resume_id", "date"])
        train = E.time_weights(train) if time else train
        model = M.Descent(match=0.1).model(train, weight="weight" if time else None)
        return E.evaluate(model(test).select("date", F.col("label").cast("int").alias("label"), "prediction"))

    return query


def _window_samples(t: Tables, test: bool) -> DataFrame:
    rows = H.training_windows(t.histories(), test=test)
    day = F.date_add(F.lit(DIVIDER).cast("date"), F.col("day").cast("int")) if test else F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("day").cast("int"))
    return rows.select(F.col("resumeid").alias("resume_id"), day.alias("date"), "day", "label", M.array_to_vector(F.col("features").cast("array<double>")).alias("features"))


def _on_windows(fit, balance=False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        train = _window_samples(t, False)
        model = fit(E.undersample(train, ["resume_id", "date"]) if balance else train)
        return E.evaluate(model(_window_samples(t, True)).select("date", F.col("label").cast("int").alias("label"), "prediction"))

    return query


def ml24_latent_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many factors each resume has, and how long its vector is."""
    factors = G.latent_factors(Tables(spark, sf_dir).weights())
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    return factors.select("resumeid", F.size("features").alias("rank"), F.round(norm, 3).alias("norm"))


def ml27_gamma_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts after the divider for several values of gamma."""
    train, test = L.date_split(Tables(spark, sf_dir).samples().persist(), DIVIDER, exclusive=True)
    of = lambda label, prediction: F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))
    measure = lambda rows: rows.agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(0, 0).alias("tn"), of(1, 0).alias("fn"))
    gammas = [k / 40 for k in range(13)]
    weights = {gamma: found[0] for gamma, found in zip(gammas, M.Descent().fit_each(train, gammas), strict=True)}
    return M.sweep(train, test, lambda _, gamma: M.Descent.scorer(weights[gamma]), gammas, measure)


def _test_window(t: Tables) -> DataFrame:
    return X.within(t.labelled(), DIVIDER, LAST_TEST_DAY)


def jn22_factor_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes with factors that also have samples in the test window."""
    t = Tables(spark, sf_dir)
    owners = _test_window(t).select(F.col("resume_id").alias("resumeid")).distinct()
    return G.latent_factors(t.weights()).join(owners, "resumeid", "left_semi").select("resumeid", F.size("features").cast("bigint").alias("rank"))


def sc1_delimited_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions written as delimited lines, some with blank fields at the end, and parsed back."""
    blank = F.when(F.col("infoid") % 10 == 0, "").otherwise(F.col("infoid").cast("string"))
    rows = Tables(spark, sf_dir).actions().select(F.concat_ws(logs.DELIMITER, F.lit("c"), "clicktag", "clicktime", F.col("userid").cast("string"), blank).alias("value"))
    return logs.parse(rows, logs.ACTIONS).select("clicktag", "clicktime", F.col("userid").cast("bigint").alias("userid"), F.col("infoid").cast("bigint").alias("infoid"))


def sc14_pair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as delimited lines, some with ids that aren't numbers, and parsed back."""
    t = Tables(spark, sf_dir)
    rid = F.when(F.col("positionid") % 7 == 0, "none").otherwise(F.col("resumeid").cast("string"))
    lines = G.pairs(t.actions(), t.registrations(), t.deliveries()).select(F.concat_ws(logs.DELIMITER, rid, F.col("positionid").cast("string"), F.col("time").cast("string"), "flag").alias("value"))
    return logs.parse_pairs(lines)


def sc5_several_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept in a folder for each of four days, read by a comma list and a character class that leave one day out."""
    base = shared_folder(spark, "sc5")
    lines = Views(spark, sf_dir).resume_lines()
    lines.select(F.concat(F.lit("2016092"), (F.col("key") % 4 + 3).cast("string")).alias("day"), "value").write.partitionBy("day").text(base)
    return logs.read_log(spark, f"{base}/day=2016092[34],{base}/day=20160926", logs.REGISTRATIONS)


def sc10_parquet_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept by date, of which a glob reads ten days."""
    base = shared_folder(spark, "sc10")
    sinks.write_by_date(Tables(spark, sf_dir).by_tag(), base)
    return logs.read_parquet(spark, f"{base}/date=2024-01-1*", base=base).withColumn("date", F.col("date").cast("date"))


def _written(write, build, read=None):
    """A query that writes a table, and gives what is then read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, path = build(Tables(spark, sf_dir)), shared_folder(spark, "sink")
        for _ in range(2):  # a sink replaces what was there
            write(table, path)
        if read:
            return read(spark, path)
        return spark.read.parquet(path).select(*[F.col(c).cast(t).alias(c) for c, t in table.dtypes])

    return query


def _pair_lines(spark: SparkSession, path: str) -> DataFrame:
    return logs.parse_pairs(spark.read.text(path))


def _neighbour_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = logs.parse(spark.read.text(path), logs.Layout({"id": 0, "rank": 1, "neighbour": 2, "distance": 3}, 4))
    return raw.select(*[F.col(c).cast("bigint").alias(c) for c in ("id", "rank", "neighbour")], F.col("distance").cast("double").alias("distance"))


def _near(t: Tables, k: int) -> DataFrame:
    return G.nearest(t.table("embeddings"), k, "vec_id", "embedding")


def sc11_labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as text, some with a bad day or number, and parsed back."""
    rid = F.col("resume_id")
    day = F.when(rid % 7 == 0, "201601").otherwise(F.date_format("date", "yyyyMMdd"))
    sent = F.when(rid % 11 == 0, "none").otherwise(F.col("delivery_count").cast("string"))
    numbers = F.concat_ws(", ", F.col("label").cast("string"), F.col("click_count").cast("string"), sent, F.col("download_count").cast("string"))
    lines = Tables(spark, sf_dir).labelled().select(F.concat(F.lit("["), rid.cast("string"), F.lit(","), day, F.lit(",("), numbers, F.lit(")]")).alias("value"))
    return logs.parse_labelled(lines).select("id", "date", "label", F.array_join(F.transform("features", lambda x: x.cast("bigint").cast("string")), ",").alias("features"))


def sc12_history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.concat(F.lit("WrappedArray("), F.array_join(F.transform(c, lambda x: x.cast("double").cast("string")), ", "), F.lit(")"))
    lines = Tables(spark, sf_dir).histories().select(F.concat(F.lit("("), F.col("resumeid").cast("string"), F.lit(",("), of("clicks"), F.lit(","), of("deliveries"), F.lit("))")).alias("value"))
    whole = lambda c: F.transform(c, lambda x: x.cast("bigint")).alias(c)
    rows = logs.parse_history(lines).select(F.col("resumeid").cast("bigint").alias("resumeid"), whole("clicks"), whole("deliveries"))
    return rows.select("resumeid", _text("clicks"), _text("deliveries"))


def sc13_similar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three neighbours of each resume and day as lines, those with fewer rejected by the layout."""
    near = G.nearest_in_day(Tables(spark, sf_dir).similar(), X.feature_names()[12:])
    pivot = near.groupBy("resumeid", "date").agg(*[F.max(F.when(F.col("rank") == n, F.col("neighbour"))).alias(f"n{n}") for n in (1, 2, 3)])
    lines = pivot.select(F.concat_ws(logs.DELIMITER, F.col("resumeid").cast("string"), F.date_format("date", "yyyyMMdd"), "n1", "n2", "n3").alias("value"))
    return logs.parse(lines, logs.SIMILAR)


def sc15_factor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text, parsed back, and their three nearest."""
    v = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", ")
    lines = Views(spark, sf_dir).table("embeddings").select(F.concat(F.lit("("), F.col("vec_id").cast("string"), F.lit(",WrappedArray("), v, F.lit("))")).alias("value"))
    return _rounded(G.nearest(logs.parse_factors(lines), 3))


def pf7_digit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "20240131").when(k % 4 == 1, "2024-01.31").when(k % 4 == 2, "").otherwise(F.col("c_name"))
    return Views(spark, sf_dir).table("customer").select("c_custkey", S.all_digits(text).alias("digits"), S.is_date_text(text).alias("day"))


def pf8_posted_when_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions whose days of adding and posting are the same."""
    rows = logs.parse(Views(spark, sf_dir).position_lines(), logs.POSITION_COUNTS).filter(logs.present("infoid") & logs.present("adddate") & logs.present("postdate"))
    days = rows.select(F.col("infoid").cast("bigint").alias("infoid"), logs.day_of_epoch("adddate").alias("added"), logs.day_of_epoch("postdate").alias("posted")).distinct()
    return days.filter("added = posted").select("infoid", F.col("added").alias("date"))


def sf12_code_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    return Views(spark, sf_dir).table("customer").select("c_custkey", S.code_distance(a, b).alias("distance"), S.code_distance(F.col("c_mktsegment"), b).alias("text_distance"))


def sf13_gender_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    titles = t.positions().select(S.title_gender(F.col("title"), "hot", "cold").alias("position")).distinct()
    return t.resumes().select("gender").distinct().join(titles).select("gender", "position", S.gender_weight(F.col("gender"), F.col("position")).alias("weight"))


def sf18_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir).table("embeddings").select("vec_id", S.normalized(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(S.squared_distance(F.col("v"), F.transform("v", lambda x: -x)), 6).alias("twice"))


def pf11_date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = L.date_split(Tables(spark, sf_dir).labelled().select("resume_id", "date", "label"), DIVIDER)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


def pf14_feature_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.append_history(Tables(spark, sf_dir).labelled(), Tables(spark, sf_dir).histories()).filter("not made_up")
    vector, past = F.array(*[F.col(c).cast("double") for c in X.feature_names()]), F.col("history").cast("array<double>")
    total = lambda tag: F.round(F.aggregate(L.slice_features(vector, past, tag), F.lit(0.0), lambda s, x: s + x), 4)
    return rows.select("resumeid", "date", *[total(t).alias(f"sum_{t.lower()}") for t in ("B", "M", "BM", "BH", "HM", "BHM")])


def jn3_rows(t: Tables) -> DataFrame:
    return t.loaded()


def _table_query(build, digits: int = 6):
    return lambda spark, sf_dir: _rounded(build(Tables(spark, sf_dir)), digits)


QUERIES = {
    "sc1_delimited_log": sc1_delimited_log,
    "sc14_pair_log": sc14_pair_log,
    "sc2_registration_log": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).resume_lines(), logs.REGISTRATIONS),
    "sc3_position_log": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).position_lines(), logs.POSITIONS),
    "sc4_resume_log": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).resume_lines(), logs.RESUMES),
    "sc5_several_folders": sc5_several_folders,
    "sc6_download_log": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).download_lines(), logs.DOWNLOADS),
    "sc7_delivery_log": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).delivery_lines(), logs.DELIVERIES),
    "sc8_position_count_log": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).position_lines(), logs.POSITION_COUNTS),
    "sc10_parquet_glob": sc10_parquet_glob,
    "sc11_labelled_text": sc11_labelled_text,
    "sc12_history_text": sc12_history_text,
    "sc13_similar_index": sc13_similar_index,
    "sc15_factor_text": sc15_factor_text,
    "sk1_by_date": _written(lambda df, path: sinks.write_by_date(df, path, files_per_date=2), lambda t: t.by_tag()),
    "sk2_single_file": _written(sinks.write_single, lambda t: t.resumes()),
    "sk3_parquet": _written(sinks.write_parquet, lambda t: t.sent()),
    "sk4_lines": _written(sinks.write_lines, lambda t: G.pairs(t.actions(), t.registrations(), t.deliveries()).select("resumeid", "positionid", "time", "flag"), _pair_lines),
    "sk6_neighbour_lines": _written(sinks.write_lines, lambda t: _rounded(_near(t, 20)).select("id", "rank", "neighbour", "distance"), _neighbour_lines),
    "pf2_present_resumes": lambda spark, sf_dir: logs.parse(Views(spark, sf_dir).resume_lines(), logs.RESUMES).filter(logs.present("resumeid")),
    "pf3_present_gender": lambda spark, sf_dir: Views(spark, sf_dir).resumes().filter(logs.present("gender")).select("resumeid", "gender"),
    "pf7_digit_texts": pf7_digit_texts,
    "pf8_posted_when_added": pf8_posted_when_added,
    "pf16_test_window": _table_query(lambda t: _test_window(t).select("resume_id", "date", "label")),
    "sf2_epoch_suffix": lambda spark, sf_dir: Views(spark, sf_dir).deliveries().select("resumeid", "positionid", "deliverytime", F.expr("substr(deliverytime, 10)").alias("suffix")),
    "jn19_inner_neighbours": _table_query(lambda t: G.neighbour_features(G.nearest_in_day(t.similar(), X.feature_names()[12:]), t.merged(), ["click_count", "delivery_count"], inner=True)),
    "jn20_resume_dates": _table_query(lambda t: H.resume_dates(t.histories())),
    "sk5_counters": _table_query(lambda t: logs_counters(t.labelled())),
    "ag1_user_clicks_daily": _table_query(lambda t: t.by_tag()),
    "jn1_click_after_register": _table_query(lambda t: X.clicks_after_registration(t.actions(), t.registrations())),
    "pf4_month_scope": _table_query(lambda t: X.within(X.delivery_days(t.deliveries()), "2024-01-10", "2024-01-19")),
    "pf1_user_deliveries": _table_query(lambda t: t.sent()),
    "jn3_resume_downloads": _table_query(jn3_rows),
    "ag3_daily_clicks": _table_query(lambda t: X.daily_clicks(t.by_tag())),
    "ag4_daily_deliveries": _table_query(lambda t: X.daily_deliveries(t.sent())),
    "wn1_period_clicks": _table_query(lambda t: t.period_clicks()),
    "wn1_period_deliveries": _table_query(lambda t: t.period_deliveries()),
    "wn2_period_downloads": _table_query(lambda t: t.period_downloads()),
    "jn6_time_series_full_outer": _table_query(lambda t: t.series()),
    "jn10_delivery_match_rows": _table_query(lambda t: t.delivery_matches()),
    "jn11_download_match_rows": _table_query(lambda t: t.download_matches()),
    "ag12_delivery_match_stats": _table_query(lambda t: X.match_statistics(t.delivery_matches())),
    "ag12_download_match_stats": _table_query(lambda t: X.match_statistics(t.download_matches())),
    "sf12_code_distance": sf12_code_distance,
    "sf13_gender_weight": sf13_gender_weight,
    "sf18_normalized": sf18_normalized,
    "so1_id_spine": _table_query(lambda t: X.id_spine(t.by_tag(), t.sent(), t.loaded(), t.series())),
    "ag6_feature_merge": _table_query(lambda t: t.merged()),
    "ag6_feature_merge_clean": _table_query(lambda t: t.merged(False)),
    "jn5_similar_resume_data": _table_query(lambda t: t.similar()),
    "ag13_active_days": _table_query(lambda t: t.active()),
    "wn3_label_horizon": _table_query(lambda t: L.label_horizon(t.active())),
    "jn8_labeled_data": _table_query(lambda t: t.labelled()),
    "jn7_labeled_full_outer": _table_query(lambda t: L.labelled_full(t.merged().select("resume_id", "date", "click_count", "delivery_count"), t.active())),
    "jn13_valid_ids": _table_query(lambda t: L.valid_ids(t.labelled().select("resume_id", "date", "label"), 20)),
    "pf11_date_split": pf11_date_split,
    "pf14_feature_slices": pf14_feature_slices,
    "jn15_history_vectors": _table_query(lambda t: t.histories().select("resumeid", _text("clicks"), _text("deliveries"))),
    "wn4_history_features": _table_query(lambda t: H.history_features(t.histories()).select("resumeid", "date", _text("history"), "history_active")),
    "wn6_history_training": _table_query(lambda t: H.training_windows(t.histories()).select("resumeid", "day", "label", _text("features"))),
    "wn7_history_test": _table_query(lambda t: H.training_windows(t.histories(), test=True).select("resumeid", "day", "label", _text("features"))),
    "jn17_append_history": _table_query(lambda t: H.append_history(t.labelled().select("resume_id", "date", "label", "click_count"), t.histories()).select("resumeid", "date", "label", "made_up", _text("history"), F.col("click_count").cast("bigint").alias("click_count"))),
    "wn12_active_day_hist": _table_query(lambda t: H.active_day_histogram(t.histories())),
    "wn9_continuous_runs": _table_query(lambda t: H.continuous_runs(t.histories())),
    "wn10_activity_span": _table_query(lambda t: H.activity_spans(t.histories())),
    "ag20_span_ratio": _table_query(lambda t: H.span_ratios(t.histories())),
    "wn8_delta3_validation": _table_query(lambda t: H.returns_after_pause(t.histories())),
    "wn11_power_sessions": _table_query(lambda t: H.power_sessions(t.histories())),
    "ag16_entities_per_day": _table_query(lambda t: H.entities_per_day(t.sent(), "resumeid").join(H.entities_per_day(t.sent(), "positionid").withColumnRenamed("n", "n_positions"), "date")),
    "so5_click_delivery_pairs": _table_query(lambda t: G.pairs(t.actions(), t.registrations(), t.deliveries())),
    "ag15_pair_weights": _table_query(lambda t: t.weights()),
    "ml25_path_counts": _table_query(lambda t: G.path_counts(t.weights())),
    "jn23_knn_top_m": _table_query(lambda t: _near(t, NEIGHBOURS)),
    "jn24_knn_in_day": _table_query(lambda t: G.nearest_in_day(t.similar(), X.feature_names()[12:]), 8),
    "jn18_neighbour_features": _table_query(lambda t: G.neighbour_features(G.nearest_in_day(t.similar(), X.feature_names()[12:]), t.merged(), ["click_count", "delivery_count"])),
    "ag21_confusion_by_date": _table_query(lambda t: E.confusion_by_date(t.rule_predictions())),
    "ag22_prf_by_date": _table_query(lambda t: E.precision_recall_by_date(t.rule_predictions())),
    "ml26_auc_by_date": _table_query(lambda t: E.auc_by_date(t.rule_predictions())),
    "ml2_oversample": _table_query(lambda t: E.oversample(t.labelled().select("resume_id", "date", (1 - F.col("label")).alias("label")))),
    "ml3_class_weights": _table_query(lambda t: E.class_weights(t.labelled().select("resume_id", "date", "label"))),
    "ml16_time_weights": _table_query(lambda t: E.time_weights(t.labelled().select("resume_id", "date", "label"))),
    "ml1_undersample": _table_query(lambda t: E.undersample(t.labelled().select("resume_id", "date", (1 - F.col("label")).alias("label")), ["resume_id", "date"])),
    "ml4_lr_sgd": _trained(_plain_sgd),
    "ml4_lr_with_history": _trained(_plain_sgd, Tables.history_samples),
    "ml4_lr_on_windows": _on_windows(_plain_sgd, balance=True),
    "ml4_lr_on_base": _trained(_plain_sgd, Tables.base_samples),
    "ml5_weighted_lr": _trained(lambda d: M.logistic(E.class_weights(d), weight="weight"), balance=False),
    "ml6_decision_tree": _trained(M.decision_tree, balance=False),
    "ml7_indexed_tree": _trained(M.indexed_tree, balance=False),
    "ml8_random_forest": _trained(M.random_forest, balance=False),
    "ml8_forest_with_history": _trained(M.random_forest, Tables.history_samples, balance=False),
    "ml8_forest_on_windows": _on_windows(M.random_forest),
    "ml8_deep_forest_on_base_and_history": _trained(lambda d: M.random_forest(d, depth=20), Tables.base_history_samples, balance=False),
    "ml9_boosted_trees": _trained(lambda d: M.boosted_trees(d), balance=False),
    "ml10_linear_svm": _trained(M.linear_svm, Tables.base_samples, balance=False),
    "ml10_svm_on_windows": _on_windows(lambda d: M.linear_svm(d, 100), balance=True),
    "ml12_rf_lr": _trained(lambda d: M.hybrid(d, M.logistic)),
    "ml12_rf_lr_with_history": _trained(lambda d: M.hybrid(d, M.logistic), Tables.history_samples),
    "ml13_gbt_lr": _trained(lambda d: M.hybrid(d, lambda x: M.logistic(x, threshold=0.01), boosted=True, depth=8)),
    "ml13_gbt_lr_sgd": _trained(lambda d: M.hybrid(d, _plain_sgd, boosted=True, trees=100, depth=8)),
    "ml15_oversampled_gd": _trained(lambda d: M.Descent().model(E.oversample(d).drop("copy")), balance=False),
    "ml16_time_lr": _trained(_time_logistic),
    "ml17_match_lr": _match_logistic(False),
    "ml18_time_match_lr": _match_logistic(True),
    "ml19_rf_match_lr": _match_logistic(False, leaves=True),
    "ml20_rf_time_lr": _trained(lambda d: M.hybrid(d, _time_logistic)),
    "ml20_rf_time_lr_with_history": _trained(lambda d: M.hybrid(d, _time_logistic), Tables.history_samples),
    "ml21_recall_controlled_lr": _trained(lambda d: M.hybrid(d, M.Descent(gamma=0.2).model), Tables.history_samples),
    "ml21_recall_controlled_time_lr": _trained(lambda d: M.hybrid(d, lambda x: _time_logistic(x, gamma=0.01)), Tables.history_samples),
    "ml22_full_data_hybrid": _trained(lambda d: M.hybrid(d, M.Descent(gamma=-0.2).model, keep=["features"], columns=list(range(42, 52))), Tables.history_samples),
    "ml24_latent_factors": ml24_latent_factors,
    "ml27_gamma_sweep": ml27_gamma_sweep,
    "ml28_id_index": _table_query(lambda t: G.index_ids(t.weights(), "resumeid")),
    "jn2_click_triples": _table_query(lambda t: t.actions().join(t.registrations(), "userid").select("resumeid", F.col("infoid").alias("positionid"), "clicktime").distinct()),
    "jn22_factor_owners": jn22_factor_owners,
    "ag23_class_counts": _table_query(lambda t: E.class_counts(t.labelled())),
}


def logs_counters(df: DataFrame) -> DataFrame:
    from strandline.sources.sinks import counters

    return counters(df, "resume_id")


FLAGSHIP = "jn8_labeled_data"
