"""Named steps composed from a list, each a DataFrame -> DataFrame function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import columns
from pointloom.operators import aggregate, filters, sampling

STEPS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        columns.activate, columns.normalize_quat, columns.clean_attrs, columns.rotate, columns.scale, columns.flip, columns.shift, columns.clip_range, columns.jitter, columns.color_translate, columns.color_adjust, columns.voxel_coord,
        filters.filter_valid, filters.filter_outliers, filters.prune, filters.drop_classes, filters.protect_classes, aggregate.recenter, aggregate.auto_contrast, sampling.voxel_sample, sampling.sample_cells, sampling.dropout, sampling.sphere_crop, sampling.shuffle,
    )
}


def step(name: str):
    """Registers a further step."""

    def add(f: Callable[..., DataFrame]):
        STEPS[name] = f
        return f

    return add


@step("set")
def set_columns(df: DataFrame, **values) -> DataFrame:
    """Constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


@step("copy")
def copy_columns(df: DataFrame, **names) -> DataFrame:
    """new=old copies of columns."""
    return df.withColumns({new: F.col(old) for new, old in names.items()})


class Pipeline:
    """``Pipeline([("shift", {"dx": 1}), ("voxel_sample", {"size": 2.0})])(df)``"""

    def __init__(self, steps):
        unknown = [n for n, _ in steps if n not in STEPS]
        if unknown:
            raise ValueError(f"unknown steps: {unknown}")
        self.steps = list(steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, args in self.steps:
            df = df.transform(STEPS[name], **args)
        return df
