"""Values parsed from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?\d+)", 1).try_cast("bigint")


def noted_count(notes: Column) -> Column:
    """The number after ``n_samples=``, ``n_sample_k=`` or ``n=``, whichever comes first in this order."""
    return F.coalesce(*(F.regexp_extract(notes, rf"(?:^|[^A-Za-z_]){name}=(\d+)", 1).try_cast("bigint") for name in ("n_samples", "n_sample_k", "n")))


def config(c: Column) -> dict[str, Column]:
    """Family, latent size, epochs and p of a configuration id such as ``stagate_d30_e500`` or ``spagcn_p0.5``."""
    stagate, spagcn = c.rlike("^stagate"), c.rlike("^spagcn")
    return {
        "family": F.when(stagate, "stagate").when(spagcn, "spagcn").otherwise("unknown"),
        "latent": F.when(stagate, F.regexp_extract(c, r"_d(\d+)", 1).try_cast("bigint")),
        "epochs": F.when(stagate, F.regexp_extract(c, r"_e(\d+)", 1).try_cast("bigint")),
        "p": F.when(spagcn, F.regexp_extract(c, r"p([0-9]*\.?[0-9]+)", 1).try_cast("double")),
    }
