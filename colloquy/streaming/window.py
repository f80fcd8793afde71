"""The last messages of each chat, kept while messages stream in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import WINDOW

OUT = "chat long, messages long, me long, other long, last_seq long"
STATE = "seqs array<long>, mine array<boolean>"


def last_window(stream: DataFrame, size: int = WINDOW) -> DataFrame:
    """From (chat, seq, who): counts by side over the ``size`` messages of highest seq, given anew with each batch.

    The state of a chat never holds more than ``size`` messages.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, mine = state.get if state.exists else ([], [])
        held = dict(zip(seqs, mine, strict=True))
        for b in batches:
            held |= dict(zip(b["seq"].tolist(), (b["who"] == "me").tolist(), strict=True))
            held = dict(sorted(held.items())[-size:])
        state.update((list(held), list(held.values())))
        me = sum(held.values())
        yield pd.DataFrame([(key[0], len(held), me, len(held) - me, max(held))], columns=["chat", "messages", "me", "other", "last_seq"])

    return stream.groupBy("chat").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
