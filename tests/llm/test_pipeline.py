import re
import zlib

import corpus_pipeline
import public_tokenizers
from framelake.llm import common, decontaminate, line_dedup, quality_rules, simhash
from tokenizers import Tokenizer

from tests.llm.test_simhash import brute_print, brute_sets

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(common.SPACES).translate(low)
    holders = {}
    for doc, text in rows.items():
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    return {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in rows.items()}


def brute_keep(rows):
    """The smallest doc_id of each group: linked are 4 bits or fewer of fingerprints, or a similarity of 0.8 or more of sets."""
    docs = sorted(rows)
    prints, sets = {d: brute_print(rows[d], 5) for d in docs}, {d: brute_sets(rows[d]) for d in docs}
    least = {d: d for d in docs}
    for k, a in enumerate(docs):
        for b in docs[:k]:
            shared = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 4 or shared and 10 * shared >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = {d: low if x == high else x for d, x in least.items()}
    return set(least.values())


def test_stages_against_brute_force(spark):
    docs = common.documents(spark, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.op4_quality_rules(spark, SF).where("kept").collect()}
    rows = brute_lines({d: t for d, t in texts.items() if d in kept})
    rows = {d: rows[d] for d in brute_keep(rows)}
    flat = lambda t: f" {' '.join(decontaminate.words_of(t))} "
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if not any(i in flat(t) for i in items)}
    assert 0 < len(rows) < len(texts)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(rows)
    for doc, pieces in got.items():
        ids = [*tokenizer.encode(rows[doc], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_stages_keep_the_columns(spark, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert line_dedup.dedup_lines(docs).count() == docs.count() and simhash.keep_one(docs).count() == 7


def python_steps_in_one_stage(df):
    """Python steps whose rows go, without an exchange, to another one's: a task then runs a worker for each."""
    above, found = [], []
    for line in df._jdf.queryExecution().executedPlan().treeString().splitlines():
        at = re.search(r"[A-Z]", line)
        if at is None:
            continue
        above = [x for x in above if x[0] < at.start()]
        near = []
        for depth, name in reversed(above):
            if "Exchange" in name:
                break
            near.append(name)
        if re.search(r"InArrow|Python", line) and any(re.search(r"InArrow|Python", name) for name in near):
            found.append(line)
        above.append((at.start(), line.split("[")[0]))
    return found


def test_stages_hold_one_python_step_a_task(spark, monkeypatch):
    docs = common.documents(spark, SF)
    once = docs.mapInArrow(lambda parts: parts, docs.schema)
    assert python_steps_in_one_stage(once.mapInArrow(lambda parts: parts, docs.schema)) and not python_steps_in_one_stage(once)
    frame, seen = type(docs), []
    write, collect = common.materialise, frame.collect
    monkeypatch.setattr(common, "materialise", lambda df, tag: (seen.append(df), write(df, tag))[1])
    monkeypatch.setattr(frame, "collect", lambda df: (seen.append(df), collect(df))[1])
    monkeypatch.setattr(simhash, "HELD_FPS", 40)  # some cells are cut
    corpus_pipeline.run(spark, SF).collect()
    assert len(seen) > 20 and [x for df in seen for x in python_steps_in_one_stage(df)] == []
