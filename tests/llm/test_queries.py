"""Each registered query on a small table of odd rows, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from weft.llm import queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")
TOXIC = "you hateful scum idiot "


def texts() -> list[str | None]:
    base = [f"the quick brown fox {k} jumps over the lazy dog number {k} and runs away into the wood {k % 3}" for k in range(30)]
    copies = ["A passage that many share, word for word, in all of them"] * 15 + ["A passage that many share, word for word, in all of them!"] * 3
    lines = [f"Line one {k}\n  SHARED line \nlast {k}" for k in range(12)]
    odd = [None, "", " \n\t", "x" * 3000, "naïve CAFÉ 中文字 \U0001f600", "one", "one two", "word " * 2000, "a\nb\n\nc", "\n\n"]
    return base + copies + lines + odd + [TOXIC + f"go away number {k}" for k in range(20)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    marks = [(i, 1, int((t or "").startswith(TOXIC))) for i, t in enumerate(texts())]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def answers(spark, sf, name):
    found = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert sorted(found) == list(range(len(texts())))
    return found


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_op1(spark, sf):
    found = answers(spark, sf, "op1_sharding")
    for i, t in enumerate(texts()):
        r = found[i]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    counts = Counter(r.shard for r in found.values())
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in found.values() if r.shard == s) == list(range(counts[s]))


def test_op4(spark, sf):
    found = answers(spark, sf, "op4_mixing")
    size = {i: len(words(t)) for i, t in enumerate(texts())}
    by = {s: sum(n for i, n in size.items() if ["a", "b", "c", None][i % 4] == s) for s in ("a", "b", "c", None)}
    goal, left, free = {}, float(sum(by.values())), {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    while free:  # what exceeds three times a source's size is shared anew
        scale = left / sum(free.values())
        full = [s for s, w in free.items() if w * scale > 3 * by[s]]
        if not full:
            goal |= {s: w * scale for s, w in free.items()}
            break
        for s in full:
            goal[s] = 3.0 * by[s]
            left -= goal[s]
            del free[s]
    for i, r in found.items():
        s = ["a", "b", "c", None][i % 4]
        assert r.size == size[i] and r.source_size == by[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    for s in by:
        taken = sum(r.taken for i, r in found.items() if ["a", "b", "c", None][i % 4] == s)
        assert abs(taken - goal[s]) <= 0.02 * goal[s] + 16  # equal rows share rounded down


def test_op5(spark, sf):
    found = answers(spark, sf, "op5_toxicity")
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, int((texts()[i] or "").startswith(TOXIC))) for i, r in found.items() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and any(b for _, b in held)


def test_op6(spark, sf):
    found = answers(spark, sf, "op6_lm")
    train = [t for i, t in enumerate(texts()) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*words(low(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(texts()):
        r, own = found[i], [*words(low(t)), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own) and r.train_tokens == total
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_op7(spark, sf):
    found = answers(spark, sf, "op7_syncmers")
    all_texts = [t or "" for t in texts()]
    for i, t in enumerate(all_texts):
        r, following = found[i], all_texts[i - 1]  # descending ids; after the last the first
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == sha(edited) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        if following == t:
            assert r.near_next == 1
    by_text: dict = {}
    for i, t in enumerate(all_texts):
        by_text.setdefault(t, set()).add(found[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r.near_edited > 0.2 for i, r in found.items() if len(all_texts[i]) > 60) > 30  # the first half is still there


def test_op8(spark, sf):
    found = answers(spark, sf, "op8_minhash")
    sets = []
    for t in texts():
        w = words(low(t))
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    for i, r in found.items():
        assert r.n_shingles == len(sets[i]) and r.component_id == top(i) and r.kept == (top(i) == i)


def test_op9(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    found = answers(spark, sf, "op9_bpe")
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = found[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_op10(spark, sf):
    found = answers(spark, sf, "op10_line_dedup")
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    held: Counter = Counter(k for t in texts() for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t in enumerate(texts()):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < 10]
        r = found[i]
        assert r.n_lines == len(lines) and r.n_dropped == len(lines) - len(kept) and r.kept_sha256 == sha("\n".join(kept))


def test_op2(spark, tmp_path):
    page = "<html><body><nav>n{0}</nav><div><h1>T &amp; {0}</h1><p>Some   text {0}<br>more</p></div></body></html>"
    spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i)) for i in range(5)] + [(9, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in queries.QUERIES["op2_html"](spark, str(tmp_path)).collect()}
    assert found[3].text == "T & 3\nSome text 3 more" and found[3].n_chars == len(found[3].text) and found[3].url == "http://h.org/3" and found[9].text == "" and found[9].n_chars == 0


def test_op3(spark, tmp_path):
    rows = [(i, [math.sin(i * 3 + k) for k in range(5)], 0) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    table = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.QUERIES["op3_top_k"](spark, str(tmp_path)).collect()}
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(table[q], v, strict=True)), i) for i, v in table.items() if i != q)[:10]
        assert [found[q, n + 1] for n in range(10)] == [(i, -s) for s, i in best]
    assert len(found) == 30
