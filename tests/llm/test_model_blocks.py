import numpy as np
import pyarrow as pa

from graphmill.llm import kneser_ney


def test_blocks_of_the_lower_level_grow_with_the_text():
    size = kneser_ney.BUCKET_CHARS
    bits = {n: kneser_ney.bucket_bits(n * size, size) for n in (1, 2, 300, 512, 2_560, 10_240, 40_960)}
    assert [bits[n] for n in (1, 2, 300, 512)] == [0, 1, 9, 9]  # one a BUCKET_CHARS of text
    for n in (2_560, 10_240):
        assert 4 ** bits[4 * n] <= 4 * 4 ** bits[n]  # a block from each bucket to each bucket below
    assert 4 ** bits[2_560] <= 2_560 * 512


def test_small_batches_are_looked_up_together(tmp_path, monkeypatch):
    store = kneser_ney.Arrays(str(tmp_path))
    h = np.sort(np.array([kneser_ney.words(w, kneser_ney.Hashes())[0] for w in "abc"]))
    for name, more in (("words", 1), ("grams1", 1), ("grams2", 1), ("contexts1", 4)):
        store.write(f"{name}-0", h, *(np.ones(3, np.uint64) for _ in range(more)))
    asked = []
    find = kneser_ney.Arrays.find
    monkeypatch.setattr(kneser_ney.Arrays, "find", lambda self, name, *a: asked.append(name) or find(self, name, *a))
    m = kneser_ney.Model(str(tmp_path), 2, 0, {0: [3, 3], 1: [3, 0, 0, 0, 0, 3], 2: [3, 0, 0, 0, 0, 3]})
    batches = [pa.record_batch([pa.array([i]), pa.array([False]), pa.array(["a b"])], names=["doc_id", "held_out", "text"]) for i in range(50)]
    got = pa.Table.from_batches(list(kneser_ney._scored(m)(batches)))
    assert got.column("doc_id").to_pylist() == list(range(50)) and len(set(got.column("score").to_pylist())) == 1
    assert len(asked) == 4
