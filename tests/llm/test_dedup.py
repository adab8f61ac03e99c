"""Line, suffix-array, substring and near-duplicate operators against brute force."""

import collections

import numpy as np
import pytest

from tessella.llm import line_dedup, near_duplicates, queries, substring_dedup, suffix_dedup
from tests.llm import brute


def table(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def check_lines(got, rows):
    gone = brute.removed_lines(rows)
    want = sorted((repr(d), 0 if t is None else t.count("\n") + 1, sorted(i for e, i in gone if e == d and d is not None)) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_lines"], list(r["removed_lines"])) for r in got) == want
    assert all(r["n_removed"] == len(r["removed_lines"]) for r in got)


def test_lines(docs, rows):
    check_lines(line_dedup.report(docs).collect(), rows)


def test_lines_query(spark, sf):
    check_lines(queries.op1_line_dedup(spark, sf).collect(), table(spark, sf))


def test_many_like_lines(spark):
    """One line in many versions: the pivots and the block pairs must find what all pairs would."""
    words = [f"t{i}" for i in range(12)]
    rows = []
    for i in range(400):
        w = list(words)
        w[i % 12] = f"v{i}"
        rows.append((i, " ".join(w + ([f"n{i}"] if i % 3 else []))))
    rows += [(400 + i, " ".join(f"t{(i + j) % 12}" for j in range(7)) + f" z{i} y{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    block = line_dedup.BLOCK
    try:
        for line_dedup.BLOCK in (block, 50):
            check_lines(line_dedup.report(df).collect(), rows)
    finally:
        line_dedup.BLOCK = block


def test_line_stage_keeps_columns(spark, docs, rows):
    out = line_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    gone = collections.defaultdict(set)
    for d, i in brute.removed_lines(rows):
        gone[d].add(i)
    want = []
    for d, t in rows:
        left = t if d is None or not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        if d is None or not gone[d] or brute.words(left):
            want.append((repr(d), left))
    assert sorted(repr((repr(r["doc_id"]), r["text"])) for r in out.collect()) == sorted(map(repr, want))


def test_short_lines(spark):
    """Lines of one and two words repeat like any other; lines without words stay."""
    texts = ["Read more\nCookie policy\n\nAdvertisement", "Advertisement\nmore Read\nRead\n \t", "read more\nRead more now\n\nAdvertisement Advertisement", "Advertisement", None, ""]
    rows = [*enumerate(texts), (None, "Advertisement\nRead more"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = brute.removed_lines(rows, least=1)
    assert gone == {(1, 0), (1, 1), (2, 3), (3, 0)}
    assert {(r["doc_id"], i) for r in line_dedup.report(df).collect() for i in r["removed_lines"]} == gone
    kept = sorted((r["doc_id"], r["text"]) for r in line_dedup.stage(spark, df, "").where("doc_id is not null").collect() if r["text"])
    assert kept == [(0, texts[0]), (0, texts[0]), (1, "Read\n \t"), (2, "read more\nRead more now\n")]


def test_short_lines_query(spark, sf):
    gone = brute.removed_lines(table(spark, sf), least=1)
    assert {(r["doc_id"], i) for r in queries.op1_line_dedup(spark, sf).collect() for i in r["removed_lines"]} == gone


def check_bytes(got, rows):
    seen = brute.first_bytes(rows)
    want = sorted((repr(d), *brute.bytes_removed(t, d, seen)) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_suffixes(docs, rows):
    check_bytes(suffix_dedup.digest(docs).collect(), rows)


def test_suffix_levels(docs, rows):
    """Batches of few passages: many levels are built, scanned and merged."""
    batch = suffix_dedup.BATCH
    try:
        suffix_dedup.BATCH = 8
        order = [(d, t) for d, t in rows if d is not None]
        text = np.array([list((t or "").encode()[:84].ljust(84)) for _, t in order], np.uint8)
        doc = np.array([d for d, _ in order])
        sort = np.argsort(doc, kind="stable")
        text, doc = text[sort], doc[sort]
        mask = suffix_dedup.seen_before(text, np.full(len(doc), 35), doc, 50)
        first: dict[bytes, int] = {}
        for d, row in zip(doc, text):
            for i in range(35):
                first.setdefault(row[i : i + 50].tobytes(), d)
        for d, row, m in zip(doc, text, mask):
            assert [bool(int(m) >> i & 1) for i in range(35)] == [first[row[i : i + 50].tobytes()] < d for i in range(35)]
    finally:
        suffix_dedup.BATCH = batch


def test_suffixes_that_are_alike_by_chance_make_no_levels(monkeypatch):
    """Passages that share their anchor and less than 50 bytes stay out of the arrays; what two documents share is found."""
    rng = np.random.default_rng(7)
    text = rng.integers(97, 123, (600, 84)).astype(np.uint8)
    text[:, 34:50] = text[0, 34:50]
    text[500:, 10:70] = text[:100, 10:70]
    text[:500, [9, 70]], text[500:, [9, 70]] = 97, 98
    added = []
    add = suffix_dedup.Family.add
    monkeypatch.setattr(suffix_dedup.Family, "add", lambda self, suffix, doc: added.append(len(suffix)) or add(self, suffix, doc))
    mask = suffix_dedup.seen_before(text, np.full(600, 35), np.arange(600), 50)
    assert sum(added) == 2 * 100 * 11
    assert (mask[:500] == 0).all() and (mask[500:] == (1 << 21) - (1 << 10)).all()


def test_anchors_alike_by_chance_are_not_repeated(spark):
    """Of documents with a 16-byte gram in common those stay in that share a whole side of it, in one task and across tasks."""
    anchors, grams = suffix_dedup.A, suffix_dedup.byte_grams(50)
    rng = np.random.default_rng(11)
    words = ["".join(map(chr, rng.integers(97, 123, 60))) for _ in range(80)]
    # the least of many grams is an anchor wherever it stands
    many = rng.integers(97, 123, 80_000).astype(np.uint8)
    h = suffix_dedup.K.Prefix(many, suffix_dedup.K.BYTE_BASE).windows(16)
    shared, least = many[h.argmin() :][:16].tobytes().decode(), int(h.min())
    texts = [w + shared + v for w, v in zip(words[:40], words[40:])]
    texts += [words[0][:43] + shared + words[40][:17] + words[1], words[2] + words[3][-17:] + shared + words[4]]
    wide = [(i, t) for i, t in enumerate(texts)]
    for parts in (1, 7):
        df = spark.createDataFrame(wide, "doc_id long, text string").repartition(parts)
        found = collections.defaultdict(set)
        for r in anchors.repeated(df, grams, 13, sides=True).collect():
            for d, k in zip(np.frombuffer(r["doc"], "i8").tolist(), np.frombuffer(r["key"], "u8").tolist()):
                found[k].add(d)
        # what is equal for 50 bytes or more is all found
        have = collections.defaultdict(set)
        for d, t in wide:
            for i in range(len(t) - 49):
                have[t[i : i + 50]].add(d)
        for window, ds in have.items():
            if len(ds) > 1:
                h = suffix_dedup.K.Prefix(np.frombuffer(window.encode(), np.uint8), suffix_dedup.K.BYTE_BASE).windows(16)
                assert ds <= found[int(h.min())]
        assert {0, 40} <= found[least] and len(found[least]) < 15


def test_marked_runs_and_removed_bytes():
    """Runs of windows by their anchor, and what masks with gaps remove, against one window after the other."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = np.concatenate([np.tile(rng.integers(97, 99, rng.integers(1, 25)), rng.integers(1, 9)) for _ in range(12)]).astype(np.uint8)
        off = np.array([0, *np.sort(rng.integers(0, len(text) + 1, 3)), len(text)])
        h = suffix_dedup.K.Prefix(text, suffix_dedup.K.BYTE_BASE).windows(16)
        known = np.unique(suffix_dedup.byte_grams(50)(text, off)[0])[::2]
        want = []
        for a, b in zip(off[:-1], off[1:]):
            for p in range(a, b - 49):
                key = h[p : p + 35].min()
                if key in known:
                    want.append((p, p + int(np.argmax(h[p : p + 35] == key)), int(key)))
        p, count, key = suffix_dedup.marked(text, off, 50, known)[:3]
        got = [(s, int(k)) for a, n, k in zip(p, count, key) for s in range(a, a + n)]
        assert got == [(s, k) for s, _, k in want]
        assert len(p) == sum(i == 0 or (want[i][1] != want[i - 1][1] or want[i][0] != want[i - 1][0] + 1) for i in range(len(want)))
        at = np.sort(rng.integers(0, max(len(text) - 84, 1), 9)).astype(np.uint32)
        mask = (rng.integers(1, 1 << 35, 9) & rng.integers(1, 1 << 35, 9) | 1).astype(np.uint64)
        whole = np.array([0, len(text) + 84])
        gone = np.zeros(whole[1], bool)
        for s, m in zip(at.tolist(), mask.tolist()):
            for i in range(35):
                if m >> i & 1:
                    gone[s + i : s + i + 50] = True
        assert (suffix_dedup.gone_bytes(whole, np.array([4]), {"doc": np.full(9, 4), "at": at, "mask": mask}, 50) == gone).all()


def test_suffix_query(spark, sf):
    check_bytes(queries.op4_suffix_array_dedup(spark, sf).collect(), table(spark, sf))


def test_suffix_texts(docs, rows):
    seen = brute.first_bytes(rows)
    for r in suffix_dedup.deduplicated(docs).collect():
        if r["doc_id"] is not None:
            text = next(t for d, t in rows if d == r["doc_id"])
            n, removed, spans, _ = brute.bytes_removed(text, r["doc_id"], seen)
            assert len(r["kept_bytes"]) == n - removed and len(r["spans"]) == spans and sum(s["end"] - s["start"] for s in r["spans"]) == removed


def check_words(got, rows):
    seen = brute.first_windows(rows)
    want = sorted((repr(d), *brute.words_removed(t, d, seen)) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_substrings(docs, rows):
    check_words(substring_dedup.digest(docs).collect(), rows)


def test_substring_query(spark, sf):
    check_words(queries.op5_substring_dedup(spark, sf).collect(), table(spark, sf))


def test_substrings_double_to_the_end(spark, monkeypatch):
    """What goes is settled where its doubling ends: a copy of 60 words by windows of 26 and 52 words, none by those of 13."""
    seen, levels = [], substring_dedup.levels

    def watched(*args):
        for level in levels(*args):
            seen.append((level[0], level[-1].count()))
            yield level

    monkeypatch.setattr(substring_dedup, "levels", watched)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, "x " + text), (2, "y z"), (3, " ".join(text.split()[20:45]) + " end")]
    check_words(substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert [size for size, _ in seen] == [13, 26, 52, 104]
    assert seen[0][1] == 0 and seen[1][1] > 0 and seen[2][1] > 0 and seen[3][1] > 0


def test_longest_repeats(docs, rows):
    got = collections.defaultdict(set)
    out = substring_dedup.longest_repeats(docs).collect()
    for r in out:
        got[r["level_words"]].add((r["doc_id"], r["start_word"]))
    assert len(out) == sum(map(len, got.values()))
    size = 13
    while True:
        where = collections.defaultdict(set)
        for d, t in rows:
            w = brute.words(t)
            if d is not None:
                for i in range(len(w) - size + 1):
                    where[tuple(w[i : i + size])].add((d, i))
        want = {x for v in where.values() if len({d for d, _ in v}) > 1 for x in v}
        assert got[size] == want
        if not want:
            break
        size *= 2


def test_longest_repeats_of_repeated_rows(spark):
    """Rows that repeat a doc_id, with one text or two, neither multiply the answers nor count as another document."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text)] * 3 + [(1, "x " + text), (2, text), (3, None)], "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in substring_dedup.longest_repeats(df).collect())
    want = [(size, d, i) for size in (13, 26, 52) for d in (1, 2) for i in range(60 - size + 1 + (d == 1))]
    assert got == collections.Counter(want)
    alone = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string")
    assert substring_dedup.longest_repeats(alone).count() == 0


def check_groups(got, rows, num, den):
    comp = brute.components(rows, num, den)
    want = sorted((repr(d), len(brute.shingles(t)), repr(comp.get(d)), d is None or comp[d] == d) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in got) == want


@pytest.mark.parametrize("num", [85, 80])
def test_near_groups(docs, rows, num):
    check_groups(near_duplicates.near_groups(docs, 5, num, 100).collect(), rows, num, 100)


def test_near_query(spark, sf):
    check_groups(queries.op9_minhash_near_dedup(spark, sf).collect(), table(spark, sf), 85, 100)


def test_near_blocks(docs, rows):
    """A cluster over the block size is searched in pairs of blocks, with the same links."""
    block = near_duplicates.BLOCK
    try:
        near_duplicates.BLOCK = 7
        check_groups(near_duplicates.near_groups(docs, 5, 85, 100).collect(), rows, 85, 100)
    finally:
        near_duplicates.BLOCK = block


def test_near_stage(spark, docs, rows):
    out = near_duplicates.stage(spark, docs, "")
    assert out.columns == docs.columns
    comp = brute.components(rows, 80, 100)
    got = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert {d for d in got if d is not None} == {d for d, c in comp.items() if d == c} and got.count(None) == 2 and got.count(7) <= 1


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)])
    ra, rb = (near_duplicates.registers(np.sort(x), np.array([0, 4000]), 512) for x in (a, b))
    est = near_duplicates.corrected((ra == rb).mean(axis=1), np.array([4000]), 4000)[0]
    assert abs(est - 0.6) < 0.08


def test_empty(empty):
    for out in (line_dedup.report(empty), suffix_dedup.digest(empty), substring_dedup.digest(empty), near_duplicates.near_groups(empty)):
        assert out.count() == 0
