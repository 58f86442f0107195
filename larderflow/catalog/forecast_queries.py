"""Forecast, sequence, scaling, boosting and scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larderflow.catalog import tables
from larderflow.catalog.registry import query, staged, staged_path
from larderflow.catalog.sql import PANEL
from larderflow.operators import baselines, boosting, scoring, sequences
from larderflow.operators.evaluation import METRICS, comparison_table, metrics, pinball_by
from larderflow.plans import lifecycle
from larderflow.plans.features import feature_columns, training_features
from larderflow.session import fresh_path
from larderflow.settings import BoostingSettings, ForecastSettings
from larderflow.sources import models, star

KEYS = ["store_id", "item_id"]
MODELS = ("naive", "seasonal_naive", "moving_avg_7", "moving_avg_28")

# Rows numbered from the end of each series, and the seven steps ahead.
TAIL = f"""{PANEL}, tail as (select store_id, item_id, date, sales,
    row_number() over (partition by store_id, item_id order by date desc) k from panel),
    steps as (select cast(unnest(generate_series(1, 7)) as int) h)"""
NEXT_DAY = "cast(date '2001-11-04' + h as date) date"


def _panel(spark, sf_dir):
    return tables.panel(spark, sf_dir).select(*KEYS, "date", "sales")


@query(
    "f01_naive",
    f"{TAIL} select store_id, item_id, h horizon, {NEXT_DAY}, sales prediction from tail cross join steps where k = 1",
)
def naive(spark, sf_dir):
    return baselines.naive(_panel(spark, sf_dir))


@query(
    "f02_seasonal_naive",
    f"{TAIL} select store_id, item_id, h horizon, {NEXT_DAY}, sales prediction from tail join steps on k = 7 - (h - 1) % 7",
)
def seasonal_naive(spark, sf_dir):
    return baselines.seasonal_naive(_panel(spark, sf_dir))


@query(
    "f02_seasonal_naive_reference_index",
    f"{TAIL} select store_id, item_id, h horizon, {NEXT_DAY}, sales prediction from tail join steps on k = 7 + (h - 1) % 7",
)
def seasonal_naive_reference_index(spark, sf_dir):
    return baselines.seasonal_naive(_panel(spark, sf_dir), reference_index=True)


@query(
    "f03_moving_average",
    f"""{TAIL}, m as (select store_id, item_id, avg(sales) filter (k <= 7) m7, avg(sales) filter (k <= 28) m28 from tail group by 1, 2)
        select store_id, item_id, 7 "window", h horizon, {NEXT_DAY}, m7 prediction from m cross join steps
        union all select store_id, item_id, 28, h, {NEXT_DAY}, m28 from m cross join steps""",
)
def moving_average(spark, sf_dir):
    parts = [
        baselines.moving_average(_panel(spark, sf_dir), window=n).withColumn("window", F.lit(n)) for n in (7, 28)
    ]
    return parts[0].unionByName(parts[1])


BACKTEST = f"""{TAIL}, hist as (select store_id, item_id, sales, k - 7 k from tail where k > 7),
    actual as (select store_id, item_id, 8 - k h, date, sales y_true from tail where k <= 7),
    means as (select store_id, item_id, avg(sales) filter (k <= 7) m7, avg(sales) filter (k <= 28) m28,
        max(sales) filter (k = 1) last from hist group by 1, 2),
    pred as (select store_id, item_id, 'naive' model, cast(h as int) h, last y_pred from means cross join steps
        union all select store_id, item_id, 'moving_avg_7', h, m7 from means cross join steps
        union all select store_id, item_id, 'moving_avg_28', h, m28 from means cross join steps
        union all select store_id, item_id, 'seasonal_naive', h, sales from hist join steps on k = 7 - (h - 1) % 7),
    backtest as (select p.store_id, p.item_id, p.model, p.h horizon, a.date, a.y_true, p.y_pred
        from pred p join actual a on p.store_id = a.store_id and p.item_id = a.item_id and p.h = a.h)"""


@query("f04_backtest", f"{BACKTEST} select * from backtest")
def backtest(spark, sf_dir):
    return baselines.backtest(_panel(spark, sf_dir))


@query(
    "f04_short_series",
    "with n as (select o_custkey, count(*) n from orders group by 1) select count(*) n_series, count(*) filter (n <= 7) n_skipped from n",
)
def short_series(spark, sf_dir):
    return baselines.short_series(star.table(spark, sf_dir, "orders"), 7, ["o_custkey"])


@query(
    "f05_seasonal_average",
    f"""{TAIL} select store_id, item_id, h horizon, {NEXT_DAY}, avg(sales) prediction from tail
        join steps on k <= 28 and k % 7 = (7 - (h - 1) % 7) % 7 group by 1, 2, 3, 4""",
)
def seasonal_average(spark, sf_dir):
    return baselines.seasonal_average(_panel(spark, sf_dir))


BOOST_FEATURES = tuple(feature_columns())


def training(spark, sf_dir):
    """Past-only features of all splits."""
    return staged(
        spark, sf_dir, "training", lambda s, d: training_features(tables.filled(s, d), event_types=star.EVENT_TYPES, gap_free=True)
    )


def fitted(spark, sf_dir):
    """The model of the training rows: fitted with the default settings and saved once, then read from its files."""

    def fit(path):
        rows = training(spark, sf_dir)
        held_out = rows.where("split = 'val'")
        models.save_model(boosting.fit(rows.where("split = 'train'"), BOOST_FEATURES, validation=held_out, stop=False), path, spark)

    return models.load_model(staged_path(spark, sf_dir, "model", fit), spark)


@query("f06_boosted_trees")
def boosted_trees(spark, sf_dir):
    """Fit on the training period, predict every row."""
    return boosting.predict(fitted(spark, sf_dir), training(spark, sf_dir)).select(*KEYS, "date", "split", "sales", "y_pred")


@query("f07_validated_boosting")
def validated_boosting(spark, sf_dir):
    """The trees up to where the validation error no longer improves: fewer than all."""
    model = boosting.stopped_early(fitted(spark, sf_dir))
    scored = boosting.predict(model, training(spark, sf_dir).where("split = 'test'"))
    return scored.select(*KEYS, "date", "sales", "y_pred", F.lit(boosting.tree_count(model)).alias("n_trees"))


# The first tree of one level, by trying every value of every feature with missing rows on either side.
STUMP_FEATURES = ("month", "day", "capped", "snap_CA")
STUMP = f"""{PANEL}, x as (select store_id, item_id, date, sales, month(date) "month", day(date) "day", snap_CA,
        case when lag(sales, 7) over w is not null then least(lag(sales, 7) over w, 60) end capped
        from panel window w as (partition by store_id, item_id order by date)),
    told as (select cast(cast(avg(sales) as float) as double) base, count(*) n, avg(sales) * count(*) s from x),
    cells as ({" union all ".join(f"select {k} k, '{c}' feature, cast({c} as double) v, count(*) n, sum(sales) s from x group by {c}"
                                  for k, c in enumerate(STUMP_FEATURES))}),
    runs as (select c.k, c.feature, c.v, sum(c.n) over w n, base * sum(c.n) over w - sum(c.s) over w g,
            coalesce(m.n, 0) miss_n, base * coalesce(m.n, 0) - coalesce(m.s, 0) miss_g, told.n all_n, base * told.n - told.s all_g
        from cells c cross join told left join (select * from cells where v is null) m on m.k = c.k
        where c.v is not null window w as (partition by c.k order by c.v)),
    sides as (select k, feature, v, true missing_left, n + miss_n n, g + miss_g g, all_n, all_g from runs
        union all select k, feature, v, false, n, g, all_n, all_g from runs),
    gains as (select *, g * g / (n + 1) + (all_g - g) * (all_g - g) / (all_n - n + 1) - all_g * all_g / (all_n + 1) gain
        from sides where n >= 1 and all_n - n >= 1),
    best as (select * from gains order by gain desc, k, v, missing_left desc limit 1)"""


def _stump(spark, sf_dir):
    """Rows with a week-old value that the first week of each series misses, and a tree of one level over all of them."""
    week_old = F.lag("sales", 7).over(Window.partitionBy(*KEYS).orderBy("date"))
    rows = tables.panel(spark, sf_dir).select(
        *KEYS, "date", "sales", "snap_CA", F.month("date").alias("month"), F.day("date").alias("day"), F.least(week_old, F.lit(60)).alias("capped")
    )
    # least() skips nulls, so a missing value is put back
    rows = rows.withColumn("capped", F.when(F.col("date") >= F.date_add(F.min("date").over(Window.partitionBy(*KEYS)), 7), F.col("capped")))
    settings = BoostingSettings(n_estimators=1, max_depth=1, subsample=1.0, colsample=1.0)
    return rows, boosting.fit(rows, STUMP_FEATURES, settings=settings)


@query(
    "f06_first_split",
    f"""{STUMP} select feature, v threshold, missing_left, round(gain / all_n, 6) gain, cast(n as bigint) n_left,
        cast(all_n - n as bigint) n_right, round(-0.1 * g / (n + 1), 6) left_value, round(-0.1 * (all_g - g) / (all_n - n + 1), 6) right_value from best""",
)
def first_split(spark, sf_dir):
    rows, model = _stump(spark, sf_dir)
    nodes = {r.node: r for r in boosting.node_table(model, spark).collect()}
    root, left, right = nodes[0], nodes[1], nodes[2]
    return spark.range(1).select(
        F.lit(model.features[root.feature]).alias("feature"),
        F.lit(root.threshold).alias("threshold"),
        F.lit(root.missing_left).alias("missing_left"),
        F.round(F.lit(root.gain / model.n_rows), 6).alias("gain"),
        F.lit(left.cover).cast("long").alias("n_left"),
        F.lit(right.cover).cast("long").alias("n_right"),
        F.round(F.lit(left.value), 6).alias("left_value"),
        F.round(F.lit(right.value), 6).alias("right_value"),
    )


@query(
    "f09_missing_features",
    f"""{STUMP}, scored as (select store_id, item_id, capped is null missing, greatest(base + case when
            coalesce(case feature when 'month' then "month" when 'day' then "day" when 'capped' then capped else snap_CA end <= v, missing_left)
            then -0.1 * g / (n + 1) else -0.1 * (all_g - g) / (all_n - n + 1) end, 0) y_pred from x cross join best cross join (select base from told))
        select store_id, item_id, missing, count(*) n_rows, round(avg(y_pred), 5) y_pred from scored group by 1, 2, 3""",
)
def missing_features(spark, sf_dir):
    """Rows that miss a feature are trained on and predicted like all others."""
    rows, model = _stump(spark, sf_dir)
    scored = boosting.predict(model, rows).groupBy(*KEYS, F.col("capped").isNull().alias("missing"))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("y_pred"), 5).alias("y_pred"))


@query(
    "f08_numeric_features",
    f"""{PANEL}, n as (select count(*) n_rows from panel)
        select unnest(['wm_yr_wk', 'sell_price', 'snap_CA', 'snap_TX', 'snap_WI']) feature, n_rows from n""",
)
def numeric_features(spark, sf_dir):
    rows = tables.panel(spark, sf_dir)
    names = [F.lit(c) for c in boosting.numeric_features(rows)]
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(F.array(*names)).alias("feature"))


@query(
    "f09_non_negative_predictions",
    f"""{PANEL}, x as (select store_id, item_id, split, date, lag(sales, 28) over (partition by store_id, item_id order by date) lag_28,
        sell_price from panel) select split, count(*) n_rows, 0::bigint n_negative, 0::bigint n_missing
        from x where lag_28 is not null group by 1""",
)
def non_negative_predictions(spark, sf_dir):
    scored = boosting.predict(fitted(spark, sf_dir), training(spark, sf_dir))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("y_pred") < 0).alias("n_negative"),
        F.count_if(F.col("y_pred").isNull()).alias("n_missing"),
    )


@query(
    "f06_every_row_is_predicted",
    f"""{PANEL}, x as (select split, lag(sales, 28) over (partition by store_id, item_id order by date) lag_28 from panel)
        select split, count(*) n_rows, count(*) n_distinct, 0::bigint n_unlike_target from x where lag_28 is not null group by 1""",
)
def every_row_is_predicted(spark, sf_dir):
    """Each row once, with the target it came with."""
    rows = training(spark, sf_dir)
    target = rows.select(*KEYS, "date", F.col("sales").alias("_target"))
    scored = boosting.predict(fitted(spark, sf_dir), rows).join(target, [*KEYS, "date"])
    return scored.groupBy("split").agg(
        F.count("y_pred").alias("n_rows"),
        F.count_distinct(F.struct(*KEYS, "date")).alias("n_distinct"),
        F.count_if(F.col("sales") != F.col("_target")).alias("n_unlike_target"),
    )


@query(
    "f10_importance_total",
    f"""{PANEL} select {len(BOOST_FEATURES)}::bigint n_features, 1.0::double total, 0::bigint n_outside
        from panel having count(*) > 0""",
)
def importance_total(spark, sf_dir):
    """Importances of all features are shares of 1."""
    shares = boosting.feature_importance(fitted(spark, sf_dir), spark, len(BOOST_FEATURES))
    return shares.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(~F.col("importance").between(0, 1)).alias("n_outside"),
    )


@query("f10_feature_importance")
def feature_importance(spark, sf_dir):
    return boosting.feature_importance(fitted(spark, sf_dir), spark, 20)


@query(
    "f11_training_sequences",
    f"""{PANEL}, x as (select store_id, item_id, date, count(*) over e encoder_len, count(*) over d decoder_len,
        sum(sales) over e encoder_sum, sum(sales) over d decoder_sum, first_value(sales) over e oldest,
        last_value(sales) over d farthest from panel
        window e as (partition by store_id, item_id order by date rows between 27 preceding and current row),
            d as (partition by store_id, item_id order by date rows between 1 following and 7 following))
        select store_id, item_id, date, cast(encoder_len as int) encoder_len, encoder_sum, decoder_sum, oldest, farthest,
            cast(1 - encoder_len as int) first_idx, 7 last_idx
        from x where encoder_len >= 14 and decoder_len >= 7""",
)
def training_sequences(spark, sf_dir):
    """Arrays reduced to sums and end points, so that SQL can check every example."""
    built = sequences.build_sequences(_panel(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return built.select(
        *KEYS,
        "date",
        "encoder_len",
        F.aggregate("encoder", F.lit(0.0), lambda acc, x: acc + x[0]).alias("encoder_sum"),
        total("decoder").alias("decoder_sum"),
        F.col("encoder")[0][0].alias("oldest"),
        F.element_at("decoder", -1).alias("farthest"),
        F.col("relative_idx")[0].alias("first_idx"),
        F.element_at("relative_idx", -1).alias("last_idx"),
    )


# Days without a target, prices known only in the past, flags and events known ahead; each array as one text.
ROLES = sequences.PanelRoles(
    static_categoricals=("store_id", "dept_id"), known_categoricals=("event_name_1",), known_reals=("snap_CA", "snap_WI"), unknown_reals=("sell_price",)
)


def _listed(field: str, frame: str) -> str:
    return f"string_agg({field}, ',' order by date) over {frame}"


@query(
    "f11_sequence_roles",
    f"""{PANEL}, t as (select *, coalesce(cast(cast(case when day(date) % 9 <> 4 then sales end as int) as varchar), '?') y,
            coalesce(cast(cast(round(sell_price * 100) as int) as varchar), '?') p, coalesce(event_name_1, '?') ev,
            snap_CA || ':' || snap_WI fl from panel),
        x as (select store_id, item_id, dept_id, date, count(*) over e encoder_len, count(*) over d decoder_len,
            {_listed("y || ':' || p || ':' || fl", "e")} enc, {_listed("ev", "e")} enc_events, {_listed("y", "d")} dec,
            {_listed("fl", "d")} dec_flags, {_listed("ev", "d")} dec_events from t
            window e as (partition by store_id, item_id order by date rows between 27 preceding and current row),
                d as (partition by store_id, item_id order by date rows between 1 following and 7 following))
        select store_id, item_id, date, cast(encoder_len as int) encoder_len, md5(enc) encoder, md5(enc_events) encoder_events, dec decoder,
            dec_flags decoder_flags, md5(dec_events) decoder_events, store_id || ',' || dept_id static
        from x where encoder_len >= 14 and decoder_len >= 7""".replace(" order by date) over", ") over"),
)
def sequence_roles(spark, sf_dir):
    """Examples with covariates by role over a panel with days without target; arrays as text, so that SQL can check every cell."""
    rows = tables.panel(spark, sf_dir).withColumn("sales", F.when(F.dayofmonth("date") % 9 != 4, F.col("sales")))
    built = sequences.build_sequences(rows, roles=ROLES)
    whole = lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("?"))
    flags = lambda x, k: F.concat_ws(":", whole(x[k]), whole(x[k + 1]))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    events = lambda c: F.md5(text(c, lambda x: F.coalesce(x[0], F.lit("?"))))
    # encoder vectors hold target, flags, price
    return built.select(
        *KEYS,
        "date",
        "encoder_len",
        F.md5(text("encoder", lambda x: F.concat_ws(":", whole(x[0]), whole(F.round(x[3] * 100)), flags(x, 1)))).alias("encoder"),
        events("encoder_categories").alias("encoder_events"),
        text("decoder", whole).alias("decoder"),
        text("decoder_reals", lambda x: flags(x, 0)).alias("decoder_flags"),
        events("decoder_categories").alias("decoder_events"),
        F.array_join("static", ",").alias("static"),
    )


@query("f11_time_index", f"{PANEL} select store_id, item_id, date, cast(date - date '1995-01-02' as int) time_idx from panel")
def time_index(spark, sf_dir):
    return sequences.time_index(tables.panel(spark, sf_dir).select(*KEYS, "date"))


@query(
    "f12_target_scaling",
    f"""{PANEL}, s as (select store_id, item_id, avg(sales) c, greatest(coalesce(stddev_samp(sales), 0), 1e-8) s from panel
        where split = 'train' group by 1, 2)
        select p.store_id, p.item_id, date, round((sales - c) / s, 4) + 0.0 sales_scaled,
            round(greatest((sales - c) / s, 0) + ln(1 + exp(-abs((sales - c) / s))), 4) softplus
        from panel p join s on p.store_id = s.store_id and p.item_id = s.item_id""",
)
def target_scaling(spark, sf_dir):
    rows = tables.panel(spark, sf_dir)
    scales = sequences.fit_scales(rows.where("split = 'train'"))
    scaled = sequences.scale_target(rows.select(*KEYS, "date", "sales"), scales)
    return scaled.select(
        *KEYS,
        "date",
        (F.round("sales_scaled", 4) + F.lit(0.0)).alias("sales_scaled"),
        F.round(sequences.softplus(F.col("sales_scaled")), 4).alias("softplus"),
    )


# Only the newest rows of a series enter: 28 of a mean before 56 origins and up to 28 steps. Kept as a table of their own, so that
# no join order can pair whole series; each residual is then a window over these rows, one step at a time.
QUANTILES = f"""{TAIL}, recent as materialized (select * from tail where k <= 120),
    ma as materialized (select *, avg(sales) over (partition by store_id, item_id order by date
        rows between 27 preceding and current row) m from recent),
    stepped as (select * from ma cross join steps),
    resid as (select store_id, item_id, h, sales - m r from (
        select store_id, item_id, h, k, sales, lag(m, cast(h as int)) over (partition by store_id, item_id, h order by date) m from stepped)
        where k between 1 and 56 and m is not null),
    q as (select store_id, item_id, h, quantile_cont(r, 0.1) r10, quantile_cont(r, 0.5) r50, quantile_cont(r, 0.9) r90
        from resid group by 1, 2, 3),
    forecast as (select q.store_id, q.item_id, q.h horizon, cast(date '2001-11-04' + q.h as date) date,
        greatest(m + r10, 0) p10, greatest(m + r50, 0) p50, greatest(m + r90, 0) p90
        from q join ma on q.store_id = ma.store_id and q.item_id = ma.item_id and ma.k = 1)"""


def _forecast(spark, sf_dir):
    return baselines.quantile_forecast(_panel(spark, sf_dir))


@query(
    "f13_quantile_forecast",
    f"""{QUANTILES} select store_id, item_id, horizon, date, round(p10, 6) p10, round(p50, 6) p50, round(p90, 6) p90
        from forecast""",
)
def quantile_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("p10", "p50", "p90")})


@query(
    "f14_pinball_loss",
    f"""{QUANTILES.replace("order by date desc) k from panel)", "order by date desc) k from panel where split <> 'test')")
        .replace("date '2001-11-04' + q.h", "date '2001-10-07' + q.h")}
        select f.horizon, round(avg(greatest(0.1 * (sales - p10), -0.9 * (sales - p10))), 6) loss_p10,
            round(avg(greatest(0.5 * (sales - p50), -0.5 * (sales - p50))), 6) loss_p50,
            round(avg(greatest(0.9 * (sales - p90), -0.1 * (sales - p90))), 6) loss_p90
        from forecast f join panel p on f.store_id = p.store_id and f.item_id = p.item_id and f.date = p.date group by 1""",
)
def pinball_loss(spark, sf_dir):
    """Quantiles from train and validation, scored on the first test week."""
    rows = tables.panel(spark, sf_dir).select(*KEYS, "date", "sales", "split")
    forecasts = baselines.quantile_forecast(rows.where("split <> 'test'"))
    scored = forecasts.join(rows.select(*KEYS, "date", F.col("sales").alias("y_true")), [*KEYS, "date"])
    losses = pinball_by(scored, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by=["horizon"])
    return losses.withColumns({c: F.round(c, 6) for c in ("loss_p10", "loss_p50", "loss_p90")})


def _requests(spark, sf_dir):
    """One request per customer: their nation as store, a part type by size of balance, a horizon from 0 to 34 or none."""
    customers = star.table(spark, sf_dir, "customer").join(
        star.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    horizon = F.when(F.col("c_custkey") % 5 != 0, F.pmod("c_custkey", F.lit(35))).cast("int")
    item = F.when(F.col("c_mktsegment") != "MACHINERY", F.when(F.col("c_acctbal") > 5000, "LARGE").otherwise("PROMO"))
    return customers.select(F.col("n_name").alias("store_id"), item.alias("item_id"), horizon.alias("forecast_horizon"))


REQUESTS = """requests as (select n_name store_id, case when c_mktsegment <> 'MACHINERY' then
        case when c_acctbal > 5000 then 'LARGE' else 'PROMO' end end item_id,
        cast(coalesce(case when c_custkey % 5 <> 0 then c_custkey % 35 end, 7) as int) forecast_horizon
    from customer join nation on c_nationkey = n_nationkey)"""


def _month_forecast(spark, sf_dir):
    return baselines.quantile_forecast(_panel(spark, sf_dir), horizon=28)


@query(
    "f15_batch_scoring",
    f"""{QUANTILES.replace("generate_series(1, 7)", "generate_series(1, 28)")}, {REQUESTS},
        valid as (select distinct * from requests where item_id is not null and forecast_horizon between 1 and 28)
        select v.store_id, v.item_id, v.forecast_horizon, count(f.horizon) n_points, round(sum(p10), 4) sum_p10,
            round(sum(p50), 4) sum_p50, round(sum(p90), 4) sum_p90, min(f.date) first_date, max(f.date) last_date
        from valid v left join forecast f on v.store_id = f.store_id and v.item_id = f.item_id and f.horizon <= v.forecast_horizon
        group by 1, 2, 3""",
)
def batch_scoring(spark, sf_dir):
    """Nested responses unfolded, so that SQL can check every point."""
    responses = scoring.score_requests(_requests(spark, sf_dir), _month_forecast(spark, sf_dir))
    points = responses.select(*KEYS, "forecast_horizon", F.explode_outer("forecasts").alias("p"))
    return points.groupBy(*KEYS, "forecast_horizon").agg(
        F.count("p.horizon").alias("n_points"),
        *[F.round(F.sum(f"p.{c}"), 4).alias(f"sum_{c}") for c in ("p10", "p50", "p90")],
        F.min("p.date").alias("first_date"),
        F.max("p.date").alias("last_date"),
    )


@query(
    "f15_rejected_requests",
    f"""with {REQUESTS} select case when item_id is null then 'item_id missing' else 'forecast_horizon not in 1..28' end reason,
        count(*) n_requests from requests where item_id is null or forecast_horizon not between 1 and 28 group by 1""",
)
def rejected_requests(spark, sf_dir):
    rejected = scoring.rejected_requests(_requests(spark, sf_dir))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n_requests"))


@query("f16_model_card")
def model_card(spark, sf_dir):
    model = fitted(spark, sf_dir)
    scored = boosting.predict(model, training(spark, sf_dir).where("split = 'test'"))
    row = metrics(scored.withColumnRenamed("sales", "y_true"), by=()).first()
    card = models.model_card(
        spark, model, "boosted_trees", "1.0.0", "boosted trees", ForecastSettings().horizon, {m: row[m] for m in METRICS}
    )
    return card


@query(
    "s11_saved_equals_fresh",
    f"""{PANEL}, x as (select split, lag(sales, 28) over (partition by store_id, item_id order by date) lag_28 from panel)
        select count(*) n_rows, 0::bigint n_different from x where lag_28 is not null and split = 'test'""",
)
def saved_equals_fresh(spark, sf_dir):
    """A model read back predicts what the one in memory does."""
    path, model = fresh_path(spark, "model"), fitted(spark, sf_dir)
    models.save_model(model, path, spark)
    rows = training(spark, sf_dir).where("split = 'test'")
    both = boosting.predict(models.load_model(path, spark), boosting.predict(model, rows, "_fresh"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("y_pred").eqNullSafe(F.col("_fresh"))).alias("n_different"))


def _scored_test(spark, sf_dir):
    """The learned model and one-day-ahead baselines on the same rows of the test period."""
    return lifecycle.beside_baselines(fitted(spark, sf_dir), training(spark, sf_dir).where("split = 'test'"))


@query("e07_with_learned_model")
def with_learned_model(spark, sf_dir):
    """The learned model compared with baselines."""
    return comparison_table(metrics(_scored_test(spark, sf_dir)), baseline="seasonal_naive")


@query(
    "e07_learned_beside_baselines",
    f"""{PANEL}, x as (select split, sales y, lag(sales, 1) over w naive, lag(sales, 7) over w seasonal_naive,
            avg(sales) over (partition by store_id, item_id order by date rows between 7 preceding and 1 preceding) moving_avg_7,
            lag(sales, 28) over w oldest from panel window w as (partition by store_id, item_id order by date)),
        scored as (select * from x where split = 'test' and oldest is not null)
        select model, round(avg(abs(y - p)), 6) MAE, round(sqrt(avg((y - p) * (y - p))), 6) RMSE,
            round(sum(abs(y - p)) / sum(abs(y)) * 100, 6) WMAPE
        from (unpivot scored on naive, seasonal_naive, moving_avg_7 into name model value p) group by 1""",
)
def learned_beside_baselines(spark, sf_dir):
    """The scores that SQL can follow of the comparison with the learned model, on the very rows that it is scored on."""
    scored = metrics(_scored_test(spark, sf_dir).where("model <> 'boosted_trees'"))
    return scored.select("model", *[F.round(m, 6).alias(m) for m in ("MAE", "RMSE", "WMAPE")])


@query("s11_saved_model")
def saved_model(spark, sf_dir):
    """Predictions of a saved and reloaded model."""
    path = fresh_path(spark, "model")
    models.save_model(fitted(spark, sf_dir), path, spark)
    scored = boosting.predict(models.load_model(path, spark), training(spark, sf_dir).where("split = 'test'"))
    return scored.select(*KEYS, "date", "sales", "y_pred")


@query("m08_judged_model")
def judged_model(spark, sf_dir):
    """From the fitted model to decisions: retraining with its reasons, and promotion over a model of 100 percent WMAPE."""
    production = spark.range(1).select(F.lit(100.0).alias("WMAPE"))
    told = lifecycle.judge(
        fitted(spark, sf_dir), training(spark, sf_dir), fresh_path(spark, "judged"), 1, F.lit("2001-11-04").cast("date"),
        F.lit("2001-09-09").cast("date"), production,
    )
    drifted = told.drift.agg(F.count_if("has_drift").alias("n_drifted"))
    one = {c: told.promotion.select(c).scalar() for c in ("candidate_wmape", "promote")}
    return told.retrain.withColumns(one | {"n_drifted": drifted.scalar()})
