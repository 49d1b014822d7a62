"""When the content of a frame was seen, against the instant it is stamped with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import filled

MODES = ("none", "constant", "exposure_var", "exposure")


def frame_shifts(df: DataFrame, modes: Sequence[str], keys: list[str], order: str, exposure: str, readout: float, bias: float = 0.0) -> DataFrame:
    """df with a column of each mode: the shift in microseconds; exposure, readout and bias are in milliseconds.

    none: nothing. constant: the bias. exposure_var: half of what the exposure is below its series' median.
    exposure: half the readout less half the exposure. Missing exposures are filled first.
    """
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"no such mode: {', '.join(sorted(unknown))}")
    if not {"exposure_var", "exposure"}.isdisjoint(modes):
        df = df.withColumn("_e", filled(exposure, keys, order))
    if "exposure_var" in modes:
        df = df.withColumn("_mid", F.percentile("_e", F.lit(0.5)).over(Window.partitionBy(*keys)))
    e = F.col("_e")
    shift = {"none": lambda: F.lit(0.0), "constant": lambda: F.lit(bias * 1000), "exposure_var": lambda: ((F.col("_mid") - e) / 2 + bias) * 1000, "exposure": lambda: (F.lit(readout) / 2 - e / 2 + bias) * 1000}
    return df.select("*", *(shift[m]().alias(m) for m in modes)).drop("_e", "_mid")
