"""What a stored table of job records says about itself.

The contract is metadata of the job-id column: how many records a job has in the table, which statuses were kept, and
the zone of its days. Spark keeps column metadata in the Parquet footers and in the catalogue, gives it back on reading,
and carries it through filters and selections, so the table and its contract can't come apart. A new column made from
the id has none, and neither has a table written by something else: such a table is taken at the caller's word.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from jobtally import schemas as S

KEY = "jobtally"
ONE_PER_JOB, ONE_PER_JOB_AND_DAY, MANY = "job", "job and day", "records"


@dataclass(frozen=True)
class Contract:
    """``grain`` is one of the three above; ``statuses`` is None where all were kept; days are those of ``zone``."""

    grain: str
    statuses: tuple[str, ...] | None = None
    zone: str = "UTC"

    def of(self, df: DataFrame) -> DataFrame:
        """The rows, with this contract."""
        held = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        return df.withMetadata(S.JOB_ID, {**df.schema[S.JOB_ID].metadata, KEY: held})


def contract_of(df: DataFrame) -> Contract | None:
    """The contract that the table was written with, if any."""
    held = df.schema[S.JOB_ID].metadata.get(KEY) if S.JOB_ID in df.columns else None
    if held is None:
        return None
    return Contract(held["grain"], None if held["statuses"] is None else tuple(held["statuses"]), held["zone"])


def check_clean(df: DataFrame, per_day: bool, statuses=None) -> None:
    """Raise where the table's own contract contradicts ``already_clean``: its records would be counted twice, or lack statuses."""
    held = contract_of(df)
    if held is None:
        return
    enough = (ONE_PER_JOB, ONE_PER_JOB_AND_DAY) if per_day else (ONE_PER_JOB,)
    if held.grain not in enough:
        raise ValueError(f"the table has one record per {held.grain}, so it is not clean for an analysis that counts every job once"
                         f"{' a day' if per_day else ''}: leave already_clean out")
    missing = set(statuses or ()) - set(held.statuses if held.statuses is not None else statuses or ())
    if missing:
        raise ValueError(f"the table was written without records of status {', '.join(sorted(missing))}")
