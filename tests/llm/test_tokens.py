"""The encoder of whole texts: what a worker's tasks share, and its table of stretches."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from sigloom.llm.bytewords import slices
from sigloom.llm.tokenbin import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(encoder, texts):
    return np.concatenate([encoder.encode(data, offsets, 2)[0] for _, _, data, offsets in slices(pa.array(texts))]).tolist()


def test_a_task_finds_what_the_one_before_has_learned(monkeypatch):
    texts = ["The quick, größe's (x.y). don't 12,5", "", "the QUICK fox, fox.", None]
    learned, learn = [], ChunkEncoder._learn
    monkeypatch.setattr(ChunkEncoder, "_learn", lambda self, hs, stretches: (learned.extend(stretches), learn(self, hs, stretches))[1])
    want = [i for t in texts for i in [*ChunkEncoder.of(PATH, "a").tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    assert ids(ChunkEncoder.of(PATH, "a"), texts) == want
    learned.clear()
    assert ids(ChunkEncoder.of(PATH, "a"), texts) == want and not learned
    assert ids(ChunkEncoder.of(PATH, "b"), texts) == want and learned  # another job begins anew


def test_stretches_whose_hashes_meet_in_one_place():
    encoder, rng = ChunkEncoder(PATH), np.random.default_rng(5)
    high = np.arange(1, 3001, dtype=np.uint64) << np.uint64(40)
    hashes = np.concatenate([high, high | np.uint64((1 << 18) - 1), rng.integers(1 << 30, 1 << 39, 300_000).astype(np.uint64)])
    hashes = np.unique(hashes)
    rng.shuffle(hashes)
    for own in np.array_split(np.arange(len(hashes)), 7):
        assert (encoder._find(hashes[own]) == -1).all()
        encoder._put(hashes[own], own)
        assert (encoder._find(hashes[: own[-1] + 1]) == np.arange(own[-1] + 1)).all()
    assert encoder.known == len(hashes) and len(encoder.keys) >= 2 * len(hashes)
