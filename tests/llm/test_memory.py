"""What the workers of the pipeline's stages hold while they work, and afterwards."""

import random
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm import _common
from sparkloom.llm.decontaminate import remove_contamination
from sparkloom.llm.language_id import _judge, train

WORDS = {"aa": ["kata", "malo", "tirra", "pelka", "sano"], "bb": ["schtu", "wunz", "grech", "holbt", "unt"]}


def rows(n, words):
    r = random.Random(1)
    return [(" ".join(r.choice(WORDS[lang]) + r.choice(WORDS[lang]) for _ in range(words)), lang) for lang in ("aa", "bb") for _ in range(n // 2)]


def test_language_is_judged_in_small_pieces():
    some = rows(1000, 300)
    model, col = train(some[:5] + some[-5:]), pa.array([t for t, _ in some])
    judge = _judge(model, 0.5, 0.1, 10)
    next(judge(col[:10]))
    tracemalloc.start()
    labels = [x for _, _, out in judge(col) for x in out["lang_id"]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert labels == [lang for _, lang in some]
    assert col.nbytes > 2e6 and peak < 60e6


def test_pieces_are_whole_rows():
    texts = ["a" * 900_000, None, "", "É" * 700_000, "b", "c" * 3_000_000, "d"]
    b = pa.RecordBatch.from_pydict({"i": list(range(7)), "text": texts})
    got = list(_common.pieces(iter([b, b.slice(0, 0), b.slice(2, 3)]), 1))
    assert [x for p in got for x in p.column("i").to_pylist()] == [*range(7), 2, 3, 4]
    assert [x for p in got for x in p.column("text").to_pylist()] == texts + texts[2:5]
    assert len(got) == 5 and max(p.num_rows for p in got) < 7


def test_lower_case_chunk_by_chunk():
    texts = ["x", "ÀÉ İ", None, "", "Abc " * 9, "ẞ"]
    col = pa.array(["skipped", *texts]).slice(1)
    for limit in (1, 12, 1 << 20):
        out = {}
        for lo, hi, buf, offs in _common.text_chunks(col, lower=True, limit=limit):
            for i in range(lo, hi):
                out[i] = buf[offs[i - lo] : offs[i - lo + 1]].tobytes().decode()
        want = pc.utf8_lower(pc.fill_null(col, "")).to_pylist()
        assert [out[i] for i in range(len(texts))] == want


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr(_common, "give_back", lambda: said.append("back"))

    def run(batches):
        for b in batches:
            said.append(b)
            yield b

    assert list(_common.lean(run)(iter([1, 2]))) == [1, 2]
    assert said == [1, 2, "back"]


def test_rewritten_in_slices(spark):
    item = " ".join(f"leak{i}" for i in range(20))
    docs = [(i, f"{'word ' * 9000}{i} " + (item if i % 3 == 0 else "clean") + f" end{i}") for i in range(150)] + [(200, item), (201, None), (202, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.text for x in remove_contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    want = {i: None if t is None else t.replace(f"{item} ", "") for i, t in docs if i != 200}
    assert got == want
