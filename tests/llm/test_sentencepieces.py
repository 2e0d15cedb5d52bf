"""What a worker remembers of parts is packed in arrays, and comes back as it was found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from agora.llm.queries import vocabulary_path
from agora.llm.sentencepieces import Pieces


def test_remembered_ways_are_packed():
    pieces = Pieces(vocabulary_path("piece_bpe_32k.model"), 3)
    texts = [f"word{k} of a text, {k * 7} times; snow ▁ {chr(0x4E00 + k)}" for k in range(3000)] + ["", "a", " "]
    first = list(pieces.segment(pa.array(texts)))
    assert pieces.parts_known > 3000 and pieces.way_at.nbytes + pieces.way_size.nbytes <= 12 * 3 * (pieces.memo.room // 2)
    assert pieces.used <= len(pieces.pool) and pieces.pool.dtype == np.dtype("<u4")
    assert list(pieces.segment(pa.array(texts))) == first
    alone = Pieces(vocabulary_path("piece_bpe_32k.model"), 3)
    for text, best in zip(texts[::500] + texts[-3:], first[::500] + first[-3:], strict=True):
        assert next(iter(alone.segment(pa.array([text])))) == best
        assert all(a[0] >= b[0] for a, b in zip(best, best[1:])) and len({x[1] for x in best}) == len(best)
        assert pieces.text(np.frombuffer(best[0][1], "<u4")).decode() == text
