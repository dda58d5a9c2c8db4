"""The moment that test flows start from."""

import datetime as dt

# A tick: 2024-01-01 00:00:00 UTC.
T0 = 1_704_067_200_000
UTC = dt.timezone.utc


def moment(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, UTC)
