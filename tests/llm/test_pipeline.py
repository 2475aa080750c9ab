"""Each stage of the pipeline against plain Python, on what the stage before kept."""

import collections
import hashlib
import importlib
import re

import pytest

from modetrace.llm import common, mixing, pii, quality

pipeline = importlib.import_module("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents, and those of each stage."""
    docs = common.table(spark, SF, "documents")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return dict(zip(["documents", *(n for n, _ in pipeline.STAGES)], out, strict=True))


def test_quality_rules(spark, stages):
    docs = common.table(spark, SF, "documents")
    trees = quality.fit(docs, common.table(spark, SF, "labels"))
    want = []
    for r in stages["documents"]:
        c = quality.counts(r.text or "")
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0]:
            x = quality.statistics(quality.np.array([c]))[0]
            logit = trees.base
            for at in trees.roots.tolist():
                while trees.left[at] != at:
                    at = int((trees.left if x[trees.feature[at]] <= trees.threshold[at] else trees.right)[at])
                logit += trees.value[at]
            if 1 / (1 + quality.np.exp(-logit)) >= quality.KEEP:
                want.append(r)
    assert sorted(map(tuple, stages["quality_rules"])) == sorted(map(tuple, want))
    assert 0 < len(want) < len(stages["documents"])


def test_near_duplicates(stages):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = sorted(stages["quality_rules"], key=lambda r: r.doc_id)
    sets, least = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(i), find(j)))
                least[high] = low
    want = [tuple(rows[i]) for i in range(len(rows)) if find(i) == i]
    assert sorted(map(tuple, stages["near_duplicates"])) == want and len(want) < len(rows)


def test_personal_data(stages):
    before, after = ({r.doc_id: r for r in stages[n]} for n in ("near_duplicates", "personal_data"))
    assert set(before) == set(after)
    for k, r in before.items():
        text, done, out = r.text or "", 0, ""
        for kind, a, b, _ in pii.find_in(text):
            if a >= done:
                out += text[done:a] + f"<{kind.upper()}>"
            done = max(done, b)
        out += text[done:]
        assert after[k].text == (r.text if r.text is None else out)
        assert (after[k].lang, after[k].source) == (r.lang, r.source) and after[k].n_chars == (len(out) if out != text else r.n_chars)
        assert pii.identifiers(out) == []


def test_target_weights(stages):
    sizes, taken = collections.Counter(), collections.Counter()
    rows = {r.doc_id: r for r in stages["personal_data"]}
    copies = collections.Counter(r.doc_id for r in stages["target_weights"])
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in stages["target_weights"]) and max(copies.values()) <= 2
    largest = 0
    for k, r in rows.items():
        n = len(WORD.findall(r.text or ""))
        largest = max(largest, n)
        sizes[r.source] += n
        taken[r.source] += n * copies[k]
    goal = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= largest for s in sizes) and sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_token_ids(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    texts = collections.defaultdict(list)
    for r in stages["target_weights"]:
        texts[r.doc_id].append(r.text or "")
    assert len(stages["token_ids"]) == len(stages["target_weights"])
    for r in stages["token_ids"]:
        text = texts[r.doc_id][0]
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
