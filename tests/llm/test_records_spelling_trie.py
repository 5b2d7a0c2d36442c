"""Token records, spelling variants and the prefix tree against plain versions."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from eralens.llm import prefix_trie, spelling, token_records  # noqa: E402
from eralens.session import scratch  # noqa: E402

SCHEMA = "doc_id bigint, text string, doc string, row bigint, word string, key string, n int"
TEXTS = [
    (3, "The quick brown fox's den, 42 times."), (1, None), (2, ""), (None, "no id here"), (7, "same"), (7, "same"), (7, "other ünder ÄÖ é – “q” <|endoftext|> Ⱥ\x00\x85x"),
    (-5, "negative id"), (9, "long word " * 9000), (8, "   \n\t "), (11, "x" * 5000), (12, "naïve straße nbsp   sep")]


@pytest.fixture(scope="module")
def docs(rows):
    return rows([(i, t, "d", 1, "w", "k", 0) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(rows):
    return rows([], SCHEMA)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_records(spark, docs, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    path = scratch(spark, "records")
    token_records.write(docs, path, token_records.tokenizer_bytes(public_tokenizers.path(name)), file_bytes=400, task_text=10_000)
    found = token_records.index(spark, path, per_block=2)
    got = sorted(found.collect(), key=lambda r: r["start"])
    have = collections.defaultdict(list)
    for i, t in TEXTS:
        have[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    want = sorted((i, len(x), zlib.crc32(x.tobytes())) for i, xs in have.items() if i is not None for x in xs)
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == [i for i, *_ in want]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got[1:]) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()] and len({r["file"] for r in got}) > 3
    # a shuffled read by the index finds every record once
    turns = token_records.epoch(found, 5, 3).collect()
    read = collections.Counter()
    for r in turns:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            key, ids = token_records.record_at(f, r["offset"], r["size"])
        read[key, zlib.crc32(ids.tobytes())] += 1
    assert read == collections.Counter((None if i is None else str(i), zlib.crc32(x.tobytes())) for i, xs in have.items() for x in xs)
    assert [r["turn"] for r in turns] != sorted(r["turn"] for r in turns) or len({r["shard"] for r in turns}) == 1
    kept = token_records.records(spark, path, keep_ids=True).where("doc_id = 3").first()
    assert kept["ids"] == have[3][0].tolist()


def test_records_export(docs, empty, spark):
    out = token_records.export(docs)
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == len(TEXTS)
    assert token_records.export(empty).count() == 0


def test_frames():
    record = token_records.frame(token_records.serialize("7", np.array([1, 70000], "<u4")))
    payload, size = token_records.unframe(memoryview(record), 0)
    assert size == len(record) and token_records.deserialize(payload)[1].tolist() == [1, 70000]
    assert token_records.record_at(io.BytesIO(b"x" + record), 1, size)[0] == "7"
    for at in (0, 9, 14, len(record) - 3, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bytes(broken)), 0)
    with pytest.raises(ValueError):
        token_records.unframe(memoryview(record[:-2]), 0)


def plain_variants(table, typo=199):
    count = collections.Counter()
    for i, t in table:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % typo == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    count = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, out = {}, {}
    beside = {w: [v for v in count if v != w and near(w, v)] for w in count}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        if best and count[best] >= 5 * count[w]:
            form[w] = best
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, count[w], len(beside[w]), count.get(form.get(w)))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_spelling(rows, block):
    rng = np.random.default_rng(4)
    letters = list("abcdeéÀßZ×÷ÿ")
    stems = ["".join(rng.choice(letters, rng.integers(5, 10))) for _ in range(25)] + ["abcabc", "aaaaaaa", "q" * 5000]
    words = []
    for s in stems:
        words += [s] * int(rng.choice([5, 30, 200, 1100]))
        for _ in range(12):
            k = int(rng.integers(0, len(s)))
            v = (s[:k] + s[k + 1:], s[:k] + str(rng.choice(letters)) + s[k:], s[:k] + str(rng.choice(letters)) + s[k + 1:])[int(rng.integers(0, 3))]
            words += [v] * int(rng.choice([1, 5, 6, 40]))
    words += ["stoneaa"] * 1000 + ["stoneab"] * 150 + ["stonebb"] * 20
    words = [words[k] for k in rng.permutation(len(words))]
    table = [(k % 90, " ".join(words[at:at + 40])) for k, at in enumerate(range(0, len(words), 40))]
    table += [(None, "aaaaaaa-AAAAAAA_aaaaaab\n" * 6), (500, None), (501, ""), (502, "Ⱥaaaaaaa “aaaaaa” 1 aaaaaac2aaaaaac"), (502, "twice twice"), (502, "twice twice")]
    frame = rows([(i, t, "d", 1, "w", "k", 0) for i, t in table], SCHEMA)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame, typo=19, block=block).collect()}
    want = plain_variants(table, 19)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (w, v[0]) for w, v in want.items())


def test_spelling_odd(rows, docs, empty):
    assert spelling.variants(empty).count() == 0
    got = {r["word"]: r["n"] for r in spelling.variants(docs).collect()}
    assert got == {w: v[2] for w, v in plain_variants(TEXTS).items()}


def plain_tree(table, shared=True):
    talks = collections.defaultdict(list)
    for c, t, r, x in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        talks[c].append((r or "", x or ""))
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for k in range(len(seq) + 1):
            members[tuple(seq[:k])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for j in range(len(k) + 1):
            saved[k[:j]] += (len(m) - 1) * words
            leaves[k[:j]] += kids[k] == 0
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


TALKS = "conv_id bigint, turn bigint, role string, text string, conv int, pos int, d int, p1 string, n string"


def tree_rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed", range(3))
def test_tree(rows, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(prefix_trie, "BLOCK", 2), monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 1)
    rng = np.random.default_rng(seed)
    words = ["hi", "a b  c", "", None, "tab\there\n", "é x y"]
    table = []
    for c in rng.choice(130, 90, replace=False).tolist():
        turns = list(range(int(rng.integers(1, 7))))
        if c % 7 == 0:
            turns[0] = None
        table += [(c, t, str(rng.choice(["user", "bot"])) if c % 11 else None, words[int(rng.choice(6, p=[.5, .2, .1, .1, .05, .05]))]) for t in turns]
    table += [(1000, k, "user", "deep talk") for k in range(60)] + [(1020 + 20 * k, t, "user", "copy of a talk") for k in range(40) for t in range(3)]
    table += [(None, 0, "user", "no id"), (2019, 0, "user", "only one turn"), (2018, 0, "user", "only one turn")]
    frame = rows([(*r, 1, 2, 3, "x", "y") for r in (table[k] for k in rng.permutation(len(table)))], TALKS)
    assert tree_rows(prefix_trie.prefix_tree(frame, shared=(20, 4))) == plain_tree(table)
    if seed == 2:
        assert tree_rows(prefix_trie.prefix_tree(frame)) == plain_tree(table, shared=False)


def test_tree_odd(rows):
    assert prefix_trie.prefix_tree(rows([], TALKS), shared=(20, 4)).count() == 0
    twice = [(5, 0, "user", "a b")] * 3 + [(25, 0, "user", "a b"), (25, 1, "user", "a b"), (25, 2, "user", "a b")]
    assert tree_rows(prefix_trie.prefix_tree(rows([(*r, 1, 2, 3, "x", "y") for r in twice], TALKS))) == plain_tree(twice, shared=False)
