"""Each text operator against a brute-force version on a small table with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import decontaminate, language, packing, pieces, quality, simhash, suffixes, superkmers, toxicity, urls, warc

CLASH = "fp string, words string, spans string, items string, anchor string, _1 string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts():
    rng = random.Random(5)
    passage, other = sentence(rng, 120), sentence(rng, 90)
    rows = [(i, sentence(rng, rng.randrange(1, 260))) for i in range(20)]
    rows += [(20 + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 20 + i)}") for i in range(12)]
    rows += [(40 + i, f"{other}\n{sentence(rng, i)}\tÄÖ {other}") for i in range(4)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (None, passage), (None, None), (54, "a" * 1500), (55, "x " * 700)]
    rows += [(56, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (57, rows[1][1].replace("1", "2", 1)), (58, sentence(rng, 9000))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), *["?"] * 6) for i, t in texts()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def result(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    own = words(low(text))
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(fps):
    """Class of each fingerprint by comparing all of them."""
    names, root = sorted(set(fps)), {}
    for f in names:
        root[f] = f
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash(docs):
    fps = [fingerprint(t) for _, t in texts()]
    root, least = groups(fps), {}
    for (i, _), f in zip(texts(), fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(texts(), fps))
    assert result(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))


@pytest.mark.parametrize("paired", [64, 0])
def test_links_connect_all_within_three_bits(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_KEYS", paired)  # 0: every key is crowded
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(6)]
    for f in list(fps):
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    root = groups(fps)
    want = defaultdict(set)
    for f in set(fps):
        want[root[f]].add(f)
    got = defaultdict(set)
    for r in found.collect():
        got[r.root].add(r.fp % (1 << 64))
    assert {frozenset({*m, r % (1 << 64)}) for r, m in got.items()} == {frozenset(s) for s in want.values() if len(s) > 1}


@pytest.mark.parametrize("crowd", [64, 1])
def test_suffix_arrays(docs, monkeypatch, crowd):
    monkeypatch.setattr(pieces, "CROWD", crowd)  # 1: every anchor is crowded
    seen = Counter()
    for _, t in texts():
        b = (t or "").encode()
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    want = Counter()
    for i, t in texts():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - 399):
            if seen[b[a : a + 400]] > 1:
                gone[a : a + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(i, len(b), runs, bytes(x for x, g in zip(b, gone) if not g))] += 1
    got = suffixes.remove_repeats(docs).withColumn("n", F.size("spans"))
    assert Counter((r.doc_id, r.n_bytes, r.n, bytes(r.kept)) for r in got.collect()) == want
    stage = suffixes.without_repeats(docs, size_col="n_chars")
    assert stage.columns == docs.columns and stage.count() == docs.count()
    assert stage.filter("text is not null and n_chars != char_length(text)").count() == 0


@pytest.mark.parametrize("crowd", [64, 1])
def test_super_k_mers(docs, monkeypatch, crowd):
    monkeypatch.setattr(pieces, "CROWD", crowd)
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in texts():
        w = words(t)
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, order(i)), order(i))
    want = Counter()
    for i, t in texts():
        w, gone = words(t), set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < order(i):
                gone |= set(range(a, a + 50))
        want[(i, len(w), " ".join(x for j, x in enumerate(w) if j not in gone).encode())] += 1
    assert Counter((r.doc_id, r.n_words, bytes(r.kept)) for r in superkmers.remove_later_copies(docs).collect()) == want


def test_decontamination(spark, docs, monkeypatch):
    found = dict(texts())
    items = [(1, " ".join(words(found[20])[40:60]).upper()), (2, "ONE"), (3, None), (4, " - "), (10, " ".join(words(found[20])[45:58])), (None, "x x x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + 10])].add("" if i is None else str(i))
    want = Counter()
    for i, t in texts():
        w, hit, names = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names |= windows[tuple(w[a : a + n])]
        want[(i, len(w), len(hit), tuple(sorted(names)), bool(hit))] += 1
    for bound in (250_000, 0):  # broadcast, and by a shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        got = decontaminate.contamination(docs, bench)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()) == want
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[4])
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_quality(docs):
    want = Counter()
    for i, t in texts():
        w, lines, seen = words(t), 0, set()
        for line in (t or "").split("\n"):
            lines += line in seen
            if words(line):
                seen.add(line)
        grams, inside = Counter(zip(w, w[1:], w[2:])), set()
        for a in range(len(w) - 2):
            if grams[tuple(w[a : a + 3])] > 1:
                inside |= {a, a + 1, a + 2}
        want[(i, len(w), sum(map(len, w)), lines, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))] += 1
    names = ("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed")
    assert result(quality.quality_rules(docs), *names) == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.quality_rules(docs).filter("kept").count()


def test_packing(docs):
    tokenizer = packing._encode_file(packing.vocabulary_file())
    rows = packing.pack(docs).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    want = Counter()
    for i, t in texts():
        ids = [*tokenizer(t or ""), packing.END_ID]
        want[i] += len(ids)
        assert any(ids[s : s + n] == np.frombuffer(b, "<u4").tolist() for s, n, b in got[i, len(ids)])
    assert Counter({i: sum(r.length for r in rows if r.doc_id == i) for i, _ in texts()}) == want
    bound = packing.pack(docs.coalesce(1), max_tokens=256, max_segments=2, max_loss=100, prompt_col="text", cut=False)
    worst = bound.groupBy("sequence_id").agg(F.sum("length"), F.count("*"), F.sum("loss_tokens")).collect()
    assert all(r[1] <= 256 and r[2] <= 2 and r[3] <= 100 for r in worst)


def test_warc(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "ü" * 5000, "x\r\n\r\ny"]
    rows = [(i, f"http://h{i % 7}.example.com:80/{i}?q=\n" if i % 5 else None, html[i % 6]) for i in range(1300)]
    rows += [rows[0], (None, "no scheme", "<p>a</p>"), (None, "http://x/", "alone")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, key string")
    archive = warc.write_archive(pages)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, u, h in rows:
        least, raw = first.get(h or ""), (h or "").encode()
        refers = None if least is None or least == i else least
        want[(i, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    assert result(warc.read_archive(archive), "page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    wanted = [rows[1][1], rows[8][1], "no scheme", "http://nowhere/"]
    found = warc.look_up(archive, spark.createDataFrame([(u,) for u in wanted], "url string"))
    assert {r.url for r in found.collect()} == set(wanted[:3])
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.org/x", "the quick brown fox"), (2, "https://m.example.org/es/1?x", "the quick"), (3, None, None), (4, "nothing", "")]
    rows += [(5, "http://example.com/de/3", ""), (6, "http://quickfox.net/casino/9", "quick fox"), (7, "http://quickfox.net", ""), (8, "a://b#://c/", "")]
    rows += [(9, "http://xexample.org/es/", ""), (6, "http://quickfox.net/casino/9", "quick fox"), (10, "http://cheapcasino.net/", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {
        1: ("a.org", "/x", "org/"), 2: ("m.example.org", "/es/1", "example.org/es/"), 3: ("", "", None), 4: ("", "", None),
        5: ("example.com", "/de/3", "com/de/"), 6: ("quickfox.net", "/casino/9", None), 7: ("quickfox.net", "", None),
        8: ("b", "", None), 9: ("xexample.org", "/es/", "org/"), 10: ("cheapcasino.net", "/", None),
    }
    assert [got[i].verdict for i in (1, 2, 5, 6, 9, 10)] == ["allow", "block", "block", "block", "allow", "block"]
    assert urls.viterbi("quickfox", {"quick": 5, "fox": 4, "x": 9}, 100) == ["quick", "fox"]
    assert urls.judge(pages.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        text = sentence(rng, rng.randrange(1, 90))
        rows.append((i, f"{text} vile{rng.randrange(30)} {sentence(rng, 9)}" if bad else text, "?"))
        labels.append((i, int(bad), "?"))
    rows += [(9001, None, "?"), (9002, "", "?"), (None, "x", "?"), (9003, "word " * 30000, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (1, None, "?"), (None, 1, "?")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [r for i, r in got.items() if i is not None and i < 9000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[9001].predicted and not got[9002].predicted
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.0}


def test_network_gradient():
    rng = np.random.default_rng(0)
    windows = [[b"ab", b"cde", b"f"], [b"cde"], [b"xy", b"ab"]]
    vocabulary, y = {b"ab": 1, b"cde": 2}, np.array([1.0, 0.0, 1.0])
    p = {k: v.astype(np.float64) for k, v in toxicity._parameters(2, 0).items()}

    def loss(q):
        scorer = toxicity.Scorer({"p": q, "vocabulary": vocabulary, "scale": 1, "shift": 0, "prior": 0})
        scorer.inputs = scorer.inputs.astype(np.float64)
        odds = scorer.odds([b" ".join(w) for w in windows])
        return float(np.mean(np.log1p(np.exp(odds)) - y * odds))

    g = toxicity._step(windows, y, p, vocabulary)
    for name, value in p.items():
        place = tuple(rng.integers(0, n) for n in value.shape)
        if name in ("char_e", "word_e"):
            place = ({"char_e": ord("c"), "word_e": 1}[name], place[1])
        up, down = ({**p, name: value.copy()} for _ in range(2))
        up[name][place] += 1e-4
        down[name][place] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[name][place]) < 1e-4, name


def test_every_language_is_learnt(spark):
    docs = spark.createDataFrame([(i, f"w{i % 210}x q{i % 210}", f"l{i % 210:03d}") for i in range(840)], "doc_id long, text string, lang string")
    learnt = {f"l{i % 210:03d}" for i in range(840) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(learnt) > 200 and set(language.train(docs)["names"]) == learnt


def test_language(spark):
    rng = random.Random(3)
    stems = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["stra", "wei", "schu", "gen"], "cc": ["qui", "eau", "ment", "ois"]}
    rows = [(i, " ".join("".join(rng.choices(stems[x], k=3)) for _ in range(rng.randrange(3, 200))), x, 0.5) for i, x in enumerate(rng.choices(list(stems), k=240))]
    rows += [(1000, None, "aa", 0.1), (1001, "", "bb", 0.1), (1002, "12 34 ---", "cc", 0.1), (None, rows[0][1], None, 0.1), (1003, rows[0][1] + " 1 " * 20000, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].lang_pred == x for i, _, x, _ in rows[:240])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None)] == ["und", "und", "und", rows[0][2]] and 0 < got[0].score <= 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_words_without_spaces_are_read_whole():
    assert language.words_of("½ ² ³ Ⅷ 12 _") == [] and language.words_of("a½ été 中文") == ["a½", "été", "中文"]
    assert language.words_of("ab" * 50 + " 1 " + "7" * 80 + "x") == ["ab" * 20, "ab" * 20, "ab" * 10, "x"]
    model = language.fit([["kalo", "mita"], ["weisch", "strage"]] * 60, ["aa", "bb"] * 60)
    assert [x for x, _ in language.label_texts(["kalo" * 10 + "weischstra" * 40, "weischstra" * 4 + "kalomita" * 50], model)] == ["bb", "aa"]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    paths = np.stack(np.meshgrid(*[range(3)] * 4, indexing="ij"), -1).reshape(-1, 4)
    score = np.exp([sum(e[0, i, p[i]] for i in range(4)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
    want = np.array([[score[paths[:, i] == j].sum() for j in range(3)] for i in range(4)]) / score.sum()
    mask = np.ones((1, 4), bool)
    np.testing.assert_allclose(language.marginals(e, mask, t)[0][0], want, atol=1e-9)
    np.testing.assert_allclose(language._label_marginals(e, mask, t)[0], want, atol=1e-9)


def test_pipeline(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(words(dict(texts())[5])[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = quality.keep_good(docs).select("doc_id", "text").collect()
    kept.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(low(r.text)) for r in kept)]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    chosen = {}
    for r, group in zip(kept, root):
        chosen.setdefault(group, r)
    assert len(chosen) < len(kept)
    width, first = corpus_pipeline.PASSAGE_BYTES, {}
    for k, r in enumerate(chosen.values()):
        b = r.text.encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], k)
    want, cut = set(), 0
    for k, r in enumerate(chosen.values()):
        b = r.text.encode()
        gone = {j for i in range(len(b) - width + 1) if first[b[i : i + width]] < k for j in range(i, i + width)}
        cut += bool(gone)
        left = bytes(x for j, x in enumerate(b) if j not in gone).decode("utf-8", "ignore")
        if f" {item} " not in f" {left} ":
            want.add((r.doc_id, len(packing.encoder(packing.vocabulary_file()).encode(left)) // 4 + 1))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.doc_tokens) for r in got.collect()} == want and cut > 5


def test_empty_tables(docs):
    none = docs.limit(0)
    for made in (simhash.near_duplicates, simhash.keep_one, suffixes.remove_repeats, superkmers.remove_later_copies, quality.quality_rules, packing.pack, language.identify):
        assert made(none).count() == 0
