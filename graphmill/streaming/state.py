"""State that streams keep: the last turns of a conversation."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: turns of a conversation that a question sees
TURNS = 5


def stream_last_turns(turns: DataFrame, n: int = TURNS) -> DataFrame:
    """A stream of turns (conv_id, turn, role) -> the last ``n`` of each conversation that a batch touches, all of them again; late turns take their place by number."""
    def step(key, frames, state: GroupState):
        held = dict(zip(*state.get)) if state.exists else {}
        for f in frames:
            held |= dict(zip(f["turn"].tolist(), f["role"].tolist()))
        last = sorted(held, reverse=True)[:n]
        state.update((last, [held[t] for t in last]))
        yield pd.DataFrame({"conv_id": key[0], "turn": last, "role": [held[t] for t in last]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, role string", "turns array<long>, roles array<string>", "update", GroupStateTimeout.NoTimeout)
