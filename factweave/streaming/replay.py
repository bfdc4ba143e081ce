"""O7 as a stream: gated replay of replies as they arrive (our extension; the batch fold is ``gating.replay``)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from factweave.operators.gating import KEYS
from factweave.sources.store import importable

OUT = "lead_id long, turn int, O1 string, O2 string, O3 string, O4 string, accepted boolean, gating_flag boolean"
STATE = "O1 string, O2 string, O3 string, O4 string, flag boolean, seen boolean"


def streamed_replay(turns: DataFrame) -> DataFrame:
    """Streaming (lead_id, turn, O1..O4, ok1..ok4, invalid) to accepted states; a lead's state is five values.

    okN says whether the turn cites evidence of a required type for ON. Turns of one micro-batch are taken in
    order; a lead's turns are taken to arrive in order across batches.
    """
    importable(turns.sparkSession)

    def step(key, pdfs: Iterator, state) -> Iterator:
        import pandas as pd

        *now, flag, seen = state.get if state.exists else ("Unknown",) * 4 + (False, False)
        rows = pd.concat(list(pdfs)).sort_values("turn")
        out = []
        for r in rows.itertuples():
            new = [getattr(r, k) or "Unknown" for k in KEYS]
            fresh = [i for i in range(4) if now[i] == "Unknown" and new[i] != "Unknown"]
            ok = not seen or not fresh or (not r.invalid and all(getattr(r, f"ok{i + 1}") for i in fresh))
            now, flag, seen = (new if ok else now), flag or not ok, True
            out.append((key[0], r.turn, *now, ok, flag))
        state.update((*now, flag, seen))
        yield pd.DataFrame(out, columns=["lead_id", "turn", *KEYS, "accepted", "gating_flag"])

    return turns.groupBy("lead_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
