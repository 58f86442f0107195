"""Fixed-length training sequences and per-series target scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from larderflow.operators.series import block_window, with_blocks
from larderflow.schemas import SERIES
from larderflow.settings import ForecastSettings

MIN_SCALE = 1e-8


@dataclass(frozen=True)
class PanelRoles:
    """Which columns are static, known in advance, or only known in the past.

    Known columns enter encoder and decoder, unknown reals and the target only the encoder; static ones stand once per example.
    """

    target: str = "sales"
    static_categoricals: tuple[str, ...] = ()
    known_categoricals: tuple[str, ...] = ()
    known_reals: tuple[str, ...] = ()
    unknown_reals: tuple[str, ...] = field(default_factory=tuple)

    def encoder_columns(self) -> list[str]:
        """Numeric columns that may enter the encoder."""
        return list(dict.fromkeys([self.target, *self.known_reals, *self.unknown_reals]))


def time_index(df: DataFrame, date: str = "date") -> DataFrame:
    """Add ``time_idx``: days since the first date of the table."""
    start = df.agg(F.min(date).alias("d")).scalar()
    return df.withColumn("time_idx", F.datediff(date, start))


def _ahead(struct: Column, w: WindowSpec, first: int, last: int, **fields: str) -> dict[str, Column]:
    """The fields of the rows ``first`` to ``last`` of the frame as arrays. Rows are gathered whole, so nulls keep their place."""
    rows = F.collect_list(struct).over(w.rowsBetween(first, last))
    return {name: rows[field] for name, field in fields.items()}


def build_sequences(
    df: DataFrame,
    columns: Sequence[str] = ("sales",),
    target: str = "sales",
    settings: ForecastSettings = ForecastSettings(),
    keys: Sequence[str] = SERIES,
    date: str = "date",
    gap_free: bool = False,
    min_decoder: int | None = None,
    roles: PanelRoles | None = None,
) -> DataFrame:
    """One training example per row that has enough past and future.

    ``encoder``: array of feature vectors of up to ``encoder_length`` rows ending at the row; ``decoder``: the next
    ``prediction_length`` targets; ``relative_idx``: positions with 0 at the row; ``encoder_len``. Decoders of fewer rows than
    ``min_decoder`` (default: the full length) are left out; a row without a target counts and stands in its place as null.

    ``roles`` name what the columns are for, in place of ``columns`` and ``target``; then there are also ``encoder_categories`` and
    ``decoder_categories`` (known categoricals of each row), ``decoder_reals`` (known reals of each row ahead) and ``static``.
    """
    past, future = settings.encoder_length, settings.prediction_length
    min_decoder = future if min_decoder is None else min_decoder
    if roles is not None:
        columns, target = roles.encoder_columns(), roles.target
    w = block_window(keys, date)
    reals = lambda names: F.array(*[F.col(c).cast("double") for c in names]).cast("array<double>")
    texts = lambda names: F.array(*[F.col(c).cast("string") for c in names]).cast("array<string>")
    seen = {"x": reals(columns)}
    ahead = {"y": F.col(target).cast("double")}
    encoder, decoder, static = {"encoder": "x"}, {"decoder": "y"}, {}
    used = [*columns, target]
    if roles is not None:
        used += [*roles.known_reals, *roles.known_categoricals, *roles.static_categoricals]
        seen |= {"c": texts(roles.known_categoricals)}
        ahead |= {"x": reals(roles.known_reals), "c": texts(roles.known_categoricals)}
        encoder |= {"encoder_categories": "c"}
        decoder |= {"decoder_reals": "x", "decoder_categories": "c"}
        static = {"static": texts(roles.static_categoricals)}
    struct = lambda parts: F.struct(*[c.alias(n) for n, c in parts.items()])
    blocks = with_blocks(df.select(*dict.fromkeys([*keys, date, *used])), keys, date, past - 1, future, gap_free)
    gathered = _ahead(struct(seen), w, -(past - 1), 0, **encoder) | _ahead(struct(ahead), w, 1, future, **decoder)
    built = blocks.withColumns(gathered | static).where("_own")
    length = F.size("encoder")
    return built.where((length >= settings.min_encoder_length) & (F.size("decoder") >= min_decoder)).select(
        *keys,
        date,
        *gathered,
        *static,
        length.alias("encoder_len"),
        F.sequence(1 - length, F.size("decoder")).alias("relative_idx"),
    )


def fit_scales(train: DataFrame, target: str = "sales", keys: Sequence[str] = SERIES) -> DataFrame:
    """Per series: ``target_center`` (mean) and ``target_scale`` (standard deviation, never 0)."""
    spread = F.coalesce(F.stddev_samp(target), F.lit(0.0))
    return train.groupBy(*keys).agg(
        F.avg(target).alias("target_center"), F.greatest(spread, F.lit(MIN_SCALE)).alias("target_scale")
    )


def scale_target(df: DataFrame, scales: DataFrame, target: str = "sales", keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``target_center``, ``target_scale`` and ``{target}_scaled``; unseen series get nulls."""
    scaled = (F.col(target) - F.col("target_center")) / F.col("target_scale")
    return df.join(scales, list(keys), "left").withColumn(f"{target}_scaled", scaled)


def unscale(value: Column) -> Column:
    """Back to units, using the scale columns beside the value."""
    return value * F.col("target_scale") + F.col("target_center")


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(y: Column) -> Column:
    """Inverse of :func:`softplus` for positive y."""
    return y + F.log(-F.expm1(-y))
