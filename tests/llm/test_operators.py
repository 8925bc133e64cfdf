"""Edge cases and brute force for every training-data operator."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import ann, decontam, langid, licenses, packing, sharding, simhash, substrings, toxicity, warc
from ledgerloom.llm.common import words_alnum, words_spaced
from ledgerloom.llm.graph import components
from ledgerloom.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k1 string, key string, shard string, words string, score string, id string, th string"
ROWS = [
    (1, "the cat and the dog are in the house with the bird", "en"), (2, "der hund und die katze sind in dem haus mit dem vogel", "de"), (3, None, "en"), (4, "", None), (5, "  \n\t ", "de"),
    (6, "the cat and the dog are in the house with the bird", "en"), (None, "the cat and the dog are in the house with the bird", None), (None, None, None), (7, "12 34 !!", "en"),
    (8, LONG, "en"), (9, LONG + " tail", "en"), (10, "before " + PASSAGE + " after it", "en"), (11, PASSAGE, "en"), (11, PASSAGE, "en"), (11, "same id other text " + PASSAGE, "en"),
    (12, "CC BY and the GNU General Public License version 3. All rights reserved. Привет мир", "en"), (13, "x" * 50_000, "en"), (14, "a", "en"), (15, "日本語 テキスト ÉCOLE élan", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", 1, 5, "a", "b", "c", "d", "e", "f", "g") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(ROWS) and sharding.shard(none).count() == 0
    texts = {}
    for r in got:
        texts.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(v) == 1 or k == (16, 0) for k, v in texts.items())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)


def test_smallest_capacity_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 50, rng.integers(1, 30))
        k = int(rng.integers(1, 8))
        ends = np.cumsum(sizes)

        def fits(c):
            n, at = 1, 0
            for s in sizes:
                if s > c:
                    return False
                if at + s > c:
                    n, at = n + 1, 0
                at += s
            return n <= k

        want = next(c for c in range(1, int(ends[-1]) + 1) if fits(c))
        assert sharding.smallest_capacity(ends, max(-(-int(ends[-1]) // k), int(sizes.max())), k) == want


def test_refined_cuts_equal_flat_cuts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_FINER", 3)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 99, 400)
    sizes[123] = 5000
    rows = [(int(i // 100), int(i % 100) + 1, int(sizes[i // 100 * 100 : i + 1].sum()), int(s)) for i, s in enumerate(sizes)]
    got = sharding.minimax_cuts(spark.createDataFrame(rows, "bucket int, r long, b_end long, bytes long"), 7)
    ends = np.cumsum(sizes)
    capacity = sharding.smallest_capacity(ends, max(-(-int(ends[-1]) // 7), 5000), 7)
    want, finer = sharding.even_cuts(ends, np.arange(1, 401), np.ones(400, bool), capacity, 7)
    assert got == want and not finer


def test_even_cuts_fill_every_shard_within_the_capacity():
    rng = np.random.default_rng(12)
    for trial in range(400):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        sizes = rng.integers(1, (20, 200)[trial % 2], n)
        if trial % 3 == 0:
            sizes[rng.integers(0, n)] *= 30
        ends = np.cumsum(sizes)
        capacity = sharding.smallest_capacity(ends, max(-(-int(ends[-1]) // k), int(sizes.max())), k)
        cuts, _ = sharding.even_cuts(ends, np.arange(1, n + 1), np.ones(n, bool), capacity, k)
        shards = np.diff([0, *cuts])
        assert set(cuts) <= set(ends.tolist()) and cuts[-1] == ends[-1] and shards.max() <= capacity and len(cuts) == min(n, k) and shards.min() > 0


def test_shards_are_minimax_and_near_equal(spark):
    rng = np.random.default_rng(13)
    rows = [(i, "x" * int(rng.integers(1, 400))) for i in range(1500)] + [(5000 + i, "hot") for i in range(60)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=12).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    groups = sharding_groups(rows)
    mean = sum(size.values()) / 12
    assert sorted(size) == list(range(12))
    assert max(size.values()) <= mean + max(groups.values()) and min(size.values()) >= mean - max(groups.values())


def sharding_groups(rows):
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t.encode()) + 16
    return groups


def test_language(docs, none, spark):
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs.where("doc_id is not null"), model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 7))
    assert langid.predict(docs, model).count() == len(ROWS)
    empty = langid.fit(none)
    assert empty.langs == [] and all(r.lang_pred == "und" for r in langid.predict(docs, empty).collect())
    assert langid.predict(none, model).count() == 0
    mixed = spark.createDataFrame([(1, ROWS[0][1] + ". " + ROWS[1][1])], "doc_id long, text string")
    s = langid.spans(mixed, model).orderBy("start").collect()
    assert [x.lang for x in s] == ["en", "de"] and s[0].start == 0
    assert langid.in_known_language(docs, model).columns == docs.columns


def test_language_stage_drops_unlearned_languages(spark):
    en = "the cat and the dog are in the house with the bird while rain falls on green fields and children walk to school every morning".split()
    de = "der hund und die katze sind in dem haus mit dem vogel und regen auf die wiese wenn kinder jeden morgen zur schule gehen".split()
    rng = np.random.default_rng(11)
    say = lambda words, n=20: " ".join(words[i] for i in rng.integers(0, len(words), n))
    learn = [(i, say(w, 40), lang) for i in range(60) for w, lang in ((en, "en"), (de, "de"))]
    model = langid.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    greek = "η γάτα και ο σκύλος είναι στο σπίτι με το πουλί"
    rows = [
        (1, say(en)), (2, say(de)), (3, greek), (4, "nelja kissaa istuu katolla ja katselee lintuja naapurin puutarhassa koko pitkan paivan"), (5, say(en) + " " + greek),
        (6, say(en, 4) + " " + greek), (7, "מים רבים לא יוכלו"), (8, say(en) + " qzxj wvkq xxq"), (9, None), (10, "12 !"), (11, say(en, 30) + " " + say(de, 12)), (12, "cat"),
    ]
    got = {r.doc_id for r in langid.in_known_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1, 2, 5, 8, 11, 12}


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for trial in range(60):
        sizes = rng.integers(0, 6, 4)
        scores = -rng.integers(0, 9, (int(sizes.sum()), 3)).astype(np.float32)
        labels, at = langid.viterbi(scores, sizes, 3.0, piece=(256, 2, 1)[trial % 3]), 0
        for n in sizes:
            s = scores[at : at + n]
            value = lambda p: sum(s[i][j] for i, j in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if n:
                best = max(value([x // 3**i % 3 for i in range(n)]) for x in range(3**n))
                assert value(labels[at : at + n].tolist()) == pytest.approx(best)
            at += n


def test_warc(spark):
    pages = [(3, "u", "<p>é</p>", 1), (1, None, "<p>é</p>", 1), (1, None, "<p>é</p>", 1), (2, 'a"b', None, 1), (4, "u", "", 1), (None, "u", "<p>é</p>", 1), (5, "u", "y" * 300_000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, refers_to long").repartition(2)
    archives = warc.write_archives(df, archive_bytes=200)
    got = warc.read_records(archives, with_payload=True).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert {r.record_type for r in by[1]} == {"response"} and by[3][0].refers_to == 1 and by[None][0].refers_to == 1 and by[4][0].refers_to == 2
    assert by[5][0].payload == b"y" * 300_000 and by[2][0].payload_bytes == 0 and by[2][0].url == 'a"b' and by[3][0].payload_bytes == len("<p>é</p>".encode())
    assert by[3][0].payload_digest == warc.digest("<p>é</p>".encode())
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_zip64_directory(tmp_path):
    """A central directory and end record that say everything in ZIP64 fields."""
    data, name = b"hello warc", b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 7)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    body = b"garbage" + local + data
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(body))
    tail = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    p = tmp_path / "x.zip"
    p.write_bytes(body + central + end64 + tail)
    with p.open("rb") as f:
        m = warc.directory(f, p.stat().st_size)[name.decode()]
        assert warc.read_range(f, warc.data_start(f, m), m.size) == data


def brute_hits(text, items, window):
    words, hit, found = words_alnum(text), set(), set()
    for i, t in items:
        for w in decontam.windows(words_alnum(t), window):
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    found.add(i)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("most", [400_000, 3])
def test_decontamination(docs, none, spark, most):
    items = [(1, " ".join(f"p{i}" for i in range(5, 30))), (2, "general public license"), (3, "a"), (4, None), (5, ""), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (10, "CAT and"), (None, "the house")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = as_counter(decontam.digest(decontam.find_occurrences(docs, bench, most_patterns=most)))
    known = [x for x in items if x[0] is not None]
    want = Counter((d, *(h := brute_hits(t, known, 10)), h[1] > 0) for d, t, _ in ROWS)
    assert got == want
    assert decontam.digest(decontam.find_occurrences(none, bench)).count() == 0
    assert all(r.n_hit == 0 for r in decontam.digest(decontam.find_occurrences(docs, bench.limit(0))).collect())
    assert decontam.clean_documents(docs, bench, most_patterns=most).count() == sum(n for k, n in want.items() if not k[-1])


def test_toxicity(docs, none, spark):
    rng = np.random.default_rng(4)
    vocab = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choice(vocab, 60).tolist()
        if bad := i % 4 == 0:
            w.insert(int(rng.integers(0, 60)), str(rng.choice(["idiotx", "moronx"])))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.fit(d, lab.where("doc_id % 3 <> 0 or doc_id is null"))
    got = {r.doc_id: r for r in toxicity.predict(d, net).collect()}
    right = [got[i].predicted == t for i, t in labels if i % 3 == 0]
    assert np.mean(right) > 0.9
    assert toxicity.predict(docs, net).count() == len(ROWS) and toxicity.predict(none, net).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.predict(docs, net).collect())
    flat = toxicity.fit(none, lab.limit(0))
    assert len({r.score for r in toxicity.predict(docs, flat).collect()}) <= 2


def test_pooled_responses_match_brute_force():
    rng = np.random.default_rng(17)
    net = toxicity.Net()
    docs = [rng.integers(1, toxicity.BUCKETS, n).astype(np.int32) for n in (0, 1, 2, 5, 40)]
    got, _ = net.pooled(*toxicity._joined(docs))
    for d, row in zip(docs, got):
        want = []
        ids = np.concatenate([d if len(d) else np.zeros(1, np.int32), np.zeros(toxicity._PAD, np.int32)])
        for w, filters, bias in zip(toxicity.WIDTHS, net.W, net.b):
            spots = [net.E[ids[i : i + w]].reshape(-1) @ filters[: len(ids[i : i + w]) * toxicity.DIM] + bias for i in range(max(1, len(d)))]
            want += np.maximum(np.max(spots, 0), 0).tolist()
        assert row == pytest.approx(want, abs=1e-5)


def test_training_rows_are_bounded_in_characters(spark):
    rows = [(i, ("bad" if i % 2 else "good") + " word" * (100_000 if i == 6 else 20)) for i in range(60)]
    d = spark.createDataFrame(rows + [(3, None), (3, "bad")], "doc_id long, text string")
    net = toxicity.fit(d, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), most_chars=20_000)
    got = {r.doc_id: r.predicted for r in toxicity.predict(d.where("text is not null"), net).collect()}
    assert [got[i] for i in (0, 1, 2, 5)] == [0, 1, 0, 1]


def test_tongues_tell_languages_apart():
    rng = np.random.default_rng(18)
    kinds = [rng.integers(1, 30_000, 40) for _ in range(3)]
    docs = [np.concatenate([rng.choice(kinds[i % 3], 60), rng.integers(1, 30_000, 60)]).astype(np.int32) for i in range(90)]
    t = toxicity.Tongues(docs)
    groups = [{t.guess(d) for d in docs[k::3]} for k in range(3)]
    assert not groups[0] & groups[1] and not groups[1] & groups[2] and not groups[0] & groups[2]
    assert t.guess(np.empty(0, np.int32)) == -1 and toxicity.Tongues([]).guess(docs[0]) == -1


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.label_documents(docs.where("doc_id is not null")).collect()}
    r = got[12]
    assert (r.n_base, r.first_word, r.base_labels) == (3, 0, "cc-by,gpl,reserved") and r.last_word == words_alnum(ROWS[15][1]).index(b"all")
    assert "gpl-3" in r.labels.split(",") and 0 < r.score < 1
    assert got[3].n_words == 0 and got[3].labels == "" and got[3].first_word is None
    assert licenses.label_documents(docs).count() == len(ROWS) and licenses.label_documents(none).count() == 0
    assert len(licenses.rules()) > 200 and all(x.keywords for x in licenses.rules())


def test_license_base_places_and_suppression():
    n, base, own = licenses.scan("é cc by cc by 4.0 and the MIT License, MIT")
    assert n == 12 and [(d.label, d.first) for d in base] == [("cc-by", 1), ("cc-by", 3)]
    assert ("cc-by-4.0", 3, 6) in {(d.label, d.first, d.last) for d in own}
    assert [d for d in own if d.label == "mit"] and not any(d.label == "cc-by" and d.first == 3 for d in own)


def test_specific_licenses_suppress_general_ones():
    own = lambda text: {d.label for d in licenses.scan(text)[2]}
    assert own("GNU Lesser General Public License version 2.1") == {"lgpl-2.1"}
    assert own("the GNU Affero General Public License version 3") == {"agpl-3"}
    assert own("GNU General Public License v2 or later") == {"gpl-2"} and own("Apache License 2.0") == {"apache-2.0"}
    assert own("Creative Commons Attribution-ShareAlike 4.0 International") == {"cc-by-sa-4.0"}


def test_resolution_by_definition():
    rng = np.random.default_rng(16)
    for _ in range(300):
        found = [licenses.Detection("x", a := int(rng.integers(0, 30)), a + int(rng.integers(0, 8)), i) for i in rng.permutation(int(rng.integers(0, 25))).tolist()]
        inside = lambda d, e: e.first <= d.first and d.last <= e.last and ((e.first, e.last) != (d.first, d.last) or e.priority < d.priority)
        left = [d for d in found if not any(inside(d, e) for e in found)]
        kept = licenses.resolve(found)
        assert set(kept) <= set(left) and all(a.last < b.first for a, b in zip(kept, kept[1:]))
        for d in set(left) - set(kept):  # crossed by one of better priority
            assert any(e.first <= d.last and d.first <= e.last and e.priority < d.priority for e in left)
    many = [licenses.Detection("x", i, i + 2, i % 7) for i in range(100_000)]
    assert licenses.resolve(many)


def test_license_base_columns_match_sql(spark):
    import duckdb

    from ledgerloom.llm.queries import _WORDS

    path = "/root/testdata/sf0.001/documents.parquet"
    sql = f"""with w as (select doc_id, {_WORDS} as w from '{path}'), p as (select * from (values ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')) v(phrase, label)),
    i as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w), f as (select doc_id, i - 1 as i, label from i, p where array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase)
    select w.doc_id, len(w)::bigint, count(label), min(i), max(i), coalesce(string_agg(distinct label, ',' order by label), '') from w left join f using (doc_id) group by 1, 2"""
    got = licenses.label_documents(spark.read.parquet(path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert as_counter(got) == Counter(duckdb.sql(sql).fetchall())


def phrases(tree, most=400):
    """Texts that a parsed regex matches: all branches, options and the ends of ranges, `most` at most."""
    import re._constants as k

    out = [""]
    for op, av in tree:
        if op is k.LITERAL:
            part = [chr(av)]
        elif op is k.IN:
            part = [x for o, a in av for x in ([chr(a)] if o is k.LITERAL else [chr(a[0]), chr(a[1])] if o is k.RANGE else ["0"] if a is k.CATEGORY_DIGIT else ["x"])]
        elif op is k.SUBPATTERN:
            part = phrases(av[3])
        elif op is k.BRANCH:
            part = [x for b in av[1] for x in phrases(b)]
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            part = [""] * (av[0] == 0) + [x * max(1, av[0]) for x in phrases(av[2])]
        else:
            part = [""] if op in (k.ASSERT, k.ASSERT_NOT) else ["x"]
        out = list(dict.fromkeys(a + b for a in out for b in part))[:most]
    return out


def test_every_license_rule_is_tried_on_its_phrases(monkeypatch):
    import re._parser

    monkeypatch.setattr(licenses, "resolve", lambda found: found)
    for rule in licenses.rules():
        for text in phrases(re._parser.parse(rule.regex.pattern)):
            assert rule.priority in {d.priority for d in licenses.scan(text)[2]}, (rule.label, text)
    assert "copyright" in {d.label for d in licenses.scan("© 2024 Name")[2]} and "openrail" in {d.label for d in licenses.scan("open rail")[2]}


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = []
    for _, t, _ in ROWS:
        w = [x.lower() for x in words_spaced(t)]
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    c = brute_components(fps, 2)
    low = {}
    for (i, _, _), k in zip(ROWS, c):
        if i is not None:
            low[k] = min(i, low.get(k, i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", low.get(k)) for (i, _, _), f, k in zip(ROWS, fps, c))
    assert simhash.near_duplicates(none).count() == 0


def test_covering_masks_cover():
    rng = np.random.default_rng(5)
    for r in (1, 2, 3):
        masks = simhash.covering_masks(r)
        for _ in range(500):
            d = sum(1 << int(b) for b in rng.choice(64, r, replace=False))
            assert any(m & d == 0 for m in masks)


@pytest.mark.parametrize("joined,in_task", [(64, 4096), (3, 4096), (3, 6)])
def test_links_in_crowded_buckets(spark, monkeypatch, joined, in_task):
    monkeypatch.setattr(simhash, "JOINED", joined)
    monkeypatch.setattr(simhash, "IN_TASK", in_task)
    rng = np.random.default_rng(6)
    fps = {0x123456789ABCDEF0}
    while len(fps) < 150:
        x = 0x123456789ABCDEF0
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    roots = {r.node: r.root for r in components(simhash.links(df, 2)).collect()}
    c = brute_components(fps, 2)
    low = {k: min(i for i, x in enumerate(c) if x == k) for k in c}
    assert [roots.get(i, i) for i in range(len(fps))] == [low[k] for k in c]


def test_components_of_a_long_chain(spark):
    e = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(500, 500), (None, 3), (900, 800)], "a long, b long"))
    got = {r.node: r.root for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[900] == 800 and got[800] == 800
    assert components(e.limit(0)).count() == 0


def test_near_duplicate_stage(spark):
    rng = np.random.default_rng(7)
    base = [f"v{i}" for i in rng.integers(0, 5000, 300)]
    near = base.copy()
    near[150] = "changed"
    other = [f"v{i}" for i in rng.integers(0, 5000, 300)]
    half = base[:150] + other[:150]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base)), (5, " ".join(half)), (6, None), (7, ""), (1, " ".join(base)), (None, "lonely text"), (9, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 3, 5, 6, 7, None])
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def texts_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicate_stage_tells_texts_of_one_id_apart(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e = (" ".join(f"v{i}" for i in rng.integers(0, 5000, 200)) for _ in range(5))
    rows = [(5, a), (None, a + " more"), (None, b), (None, c), (6, d), (6, e), (7, e + " more"), (6, b + " more"), (None, c)]
    kept = simhash.drop_near_duplicates(texts_frame(spark, rows).repartition(3))
    assert as_counter(kept.select("doc_id", "text")) == Counter([(5, a), (None, c), (6, d), (6, e), (6, b + " more")])


def test_similar_links_match_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        sets = []
        for _ in range(60):
            x = set(range(int(rng.integers(0, 30)))) | set(rng.integers(1000, 1200, int(rng.integers(1, 9))).tolist())
            sets.append(np.array(sorted(x), np.uint32))
        group = np.array([i - i % 2 if i < 20 else i for i in range(60)])
        root = {int(g): int(g) for g in group}

        def find(x):
            return x if root[x] == x else find(root[x])

        for i in range(60):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(int(group[i])), find(int(group[j]))
                    root[max(a, b)] = min(a, b)
        want = {g: find(g) for g in root}
        root = {int(g): int(g) for g in group}
        for a, b in simhash.similar_links(sets, group, 0.8):
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert {g: find(g) for g in root} == want


@pytest.mark.parametrize("block", [1000, 7])
def test_near_copies_that_share_a_template(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(10)
    template = [f"t{i}" for i in range(240)]
    rows, i = [(0, " ".join(template))], 1
    for pair in range(60):
        own = [f"p{pair}x{i}" for i in rng.integers(0, 9999, 90)]
        for copy in range(2):
            rows.append((i, " ".join(template + own[:-2] + [f"end{copy}", "x"])))
            i += 1
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    lost = {b for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(lost) == 60
    kept = {r.doc_id for r in simhash.drop_near_duplicates(texts_frame(spark, rows)).collect()}
    assert kept == set(sets) - lost


def brute_repeats(rows, window):
    first = {}
    for i, t, _ in rows:
        w = words_spaced(t)
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s : s + window])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t, _ in rows:
        w = words_spaced(t)
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return Counter(out)


def test_substrings(docs, none):
    assert as_counter(substrings.remove_repeats(docs)) == brute_repeats(ROWS, 50)
    assert substrings.remove_repeats(none).count() == 0
    left = substrings.documents_without_repeats(docs).collect()
    assert len(left) == len(ROWS) - 2 + 0 and not any(r.text == "" and r.doc_id == 11 for r in left)


def test_substrings_random(spark):
    rng = np.random.default_rng(8)
    blocks = [[f"b{j}x{i}" for i in rng.integers(0, 9, 25)] for j in range(12)]
    blocks[3] = ["again"] * 25
    rows = [(int(i), " ".join(w for b in rng.integers(0, 12, 9) for w in blocks[b]), "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for window in (50, 20, 8):
        assert as_counter(substrings.remove_repeats(df, window=window)) == brute_repeats(rows, window)


@pytest.mark.parametrize("group_words", [50_000, 3000, 60])
def test_substrings_of_a_passage_that_a_third_of_all_documents_share(spark, monkeypatch, group_words):
    monkeypatch.setattr(substrings, "GROUP_WORDS", group_words)
    rng = np.random.default_rng(14)
    passage, rows = [f"p{i}" for i in range(120)], []
    for i in range(240):
        own = [f"o{x}" for x in rng.integers(0, 40 if i % 5 else 5000, 120)]
        cut = int(rng.integers(0, 60))
        rows.append((i, " ".join(own[:60] + passage[cut:] + own[60:] if i % 3 == 0 else own), "en"))
    rows += [(300, " ".join(["lorem"] * 400), "en"), (301, " ".join(["lorem"] * 300 + passage), "en")]
    spans = lambda df, **kw: substrings.repeated_spans(df, group_words=group_words, **kw)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: substrings.covered(len(t.split()), r.starts, r.counts, 50).sum() for r in spans(df).collect() for i, t, _ in rows if i == r.doc_id}
    want = {i: gone for i, _, gone, _ in brute_repeats(rows, 50)}
    assert {i: int(got.get(i, 0)) for i in want} == want and sum(want.values()) > 5000


def test_tree_nodes_match_word_comparison():
    rng = np.random.default_rng(15)
    for window in (3, 8, 13, 50):
        runs, counts = [], []
        for _ in range(30):
            n = int(rng.integers(1, 9))
            runs.append(b" ".join(b"w%d" % x for x in rng.integers(0, 2, n + window - 1)))
            counts.append(n)
        owners = rng.integers(0, 99, 30)
        suffixes = [(tuple(r.split()[s : s + window]), int(o)) for r, n, o in zip(runs, counts, owners) for s in range(n)]
        least = {}
        for k, o in suffixes:
            least[k] = min(o, least.get(k, o))
        assert substrings.tree_nodes(runs, np.array(counts), owners, window).tolist() == [least[k] for k, _ in suffixes]


def test_documents_without_repeats_needs_no_other_columns(spark, none):
    df = spark.createDataFrame([(1, PASSAGE), (2, "new words " + PASSAGE), (3, None), (None, PASSAGE)], "doc_id int, text string")
    got = substrings.documents_without_repeats(df)
    assert got.schema == df.schema and as_counter(got) == Counter([(1, PASSAGE), (2, "new words"), (3, None), (None, PASSAGE)])
    assert substrings.documents_without_repeats(none).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(tk.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in ROWS)
    by_doc, by_seq, doubles = {}, {}, []
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
    for (i, n), parts in by_doc.items():
        copies = sum(s == 0 for s, _ in parts)
        if copies == 1:
            assert want[(i, sum((x for _, x in sorted(parts)), ()))] == 1
        doubles += [i] * copies
    assert Counter(doubles) == Counter(i for i, _, _ in ROWS)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer

    tk, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    texts = ["a <|startoftext|> b", "<|endoftext|>", "end<|endoftext|>of 12 <|startoftext|>", "Été<|endoftext|>日本語 x", "a <|STARTOFTEXT|> b <|EndOfText|>", "<|startof text|> plain"]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49406 in want[0] and want[1] == [49407] and not {49406, 49407} & set(want[4])
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.CachedTokenizer(path).ids(texts)] == want


def test_pack_histogram_places_everything():
    rng = np.random.default_rng(9)
    for _ in range(30):
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 20, 40), rng.integers(1, 500, 40))}
        patterns = packing.pack_histogram(h, 100)
        used = Counter()
        for p in patterns:
            assert sum(a * b for a, b in p.items) <= 100
            for length, times in p.items:
                used[length] += times * p.count
        assert used == Counter(h)
        n, need = sum(p.count for p in patterns), sum(a * b for a, b in h.items()) / 100
        assert n <= 1.2 * need + 2


def test_pack_histogram_is_shortest_pack_first_piece_by_piece():
    rng = np.random.default_rng(19)
    for _ in range(60):
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 60, 12), rng.integers(1, 40, 12))}
        packs: list[int] = []
        for length in sorted((x for x, n in h.items() for _ in range(n)), reverse=True):
            at = min(range(len(packs)), key=packs.__getitem__, default=None)
            if at is not None and packs[at] + length <= 100:
                packs[at] += length
            else:
                packs.append(length)
        got = Counter()
        for p in packing.pack_histogram(h, 100):
            got[sum(a * b for a, b in p.items)] += p.count
        assert got == Counter(packs)


def test_nearest(spark):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 900)] + 0.7 * rng.standard_normal((900, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [None] + [1.0] * 23), (5080, [1.0, 2.0]), (None, [1.0] * 24), (7, x[7].tolist())]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, block=300, query_block=20).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, ann.nearest(df.repartition(5), block=300).collect()))
    y = np.vstack([x, x[7:8]]).astype(np.float64)
    ids = np.append(np.arange(900), 7)
    by, hits = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 900, 20))
    for q, rs in by.items():
        s = y @ y[q]
        want = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(abs(r.score - y[r.vec_id] @ y[q]) < 1e-9 for r in rs)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(rs, rs[1:]))
        hits += sum((Counter(want) & Counter(r.vec_id for r in rs)).values())
    assert hits / (20 * len(by)) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_index_retrieves_all_within_radius():
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    codes[:300] = codes[0] ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64))
    index = ann.MultiIndex(codes)
    for r in (0, 1, 5, 9, 20, 64):
        assert index.within(codes[0], r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= r).tolist()


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "cat and the dog are in the house with the bird")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 2 in ids and not ids & {1, 3, 4, 5, 6, 7, 9} and 8 in ids


def test_language_sample_of_repeated_and_null_ids(spark):
    """Rows of one id, or without ids, are sampled by their texts; rows that are all alike still teach their language."""
    words = {"en": "the cat and the dog are here with number", "de": "der hund und die katze sind da mit nummer"}
    rows = [(9 if i % 2 else None, f"{words[lang]} {i}", lang) for i in range(3000) for lang in words]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=500)
    assert model.langs == ["de", "en"]
    same = spark.createDataFrame([(9, words[lang], lang) for _ in range(1500) for lang in words], "doc_id long, text string, lang string")
    model = langid.fit(same, most_rows=500)
    assert model.langs == ["de", "en"]
    got = langid.predict(spark.createDataFrame([(1, words["de"], None)], "doc_id long, text string, lang string"), model).first()
    assert got.lang_pred == "de"
