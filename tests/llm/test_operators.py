"""The ten operators on small fixtures, against brute force, exact round trips, or held-out accuracy."""

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, decontam, langid, line_dedup, media, near_dup, quality, revisits, toxicity
from textloom.llm.components import components
from textloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "a", "x" * 50_000, "word " * 8000, "word " * 8000, "ünï 😀 中文"]


def docs(spark, texts, more=()):
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)] + list(more)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, words, 60)) for _ in range(n)]


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (110, 2))] + [(500, 500), (3, 4), (4, 3)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = {n: n for e in links for n in e}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates_against_brute_force(spark):
    base = prose(2, 30)
    texts = [*base, *base[:5]]
    for k in range(10):
        words = base[k].split()
        words[k * 5] = "edit"
        texts.append(" ".join(words))
    texts += ODD
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    for percent in (80, 85):
        sets = [sh(t) for t in texts]
        root = list(range(len(texts)))
        for _ in range(5):
            for a, b in itertools.combinations(range(len(texts)), 2):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, texts), percent).collect()}
        assert [got[i].component_id for i in range(len(texts))] == root
        assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    none = near_dup.near_duplicates(docs(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert none.component_id is None and none.kept


def test_near_duplicates_in_a_crowd_under_the_threshold(spark):
    rng = np.random.default_rng(5)
    texts, base = [], [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    for k in range(120):  # the base itself isn't there; most members are just too far from each other
        words = list(base)
        for j in rng.choice(300, rng.integers(3, 9), False):
            words[j] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = list(range(120))
    for _ in range(120):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert 5 < len(set(root)) < 115
    assert [r.component_id for r in near_dup.near_duplicates(docs(spark, texts), 85).orderBy("doc_id").collect()] == root
    hashed = list(near_dup.shingle_sets(pa.array(texts)))
    counts = np.zeros(near_dup.SLOTS, np.int64)
    for s in hashed:
        np.add.at(counts, near_dup._slots(s), 1)
    prefixes = [set(near_dup.prefix(s, counts, 85)[0].tolist()) for s in hashed]
    assert all(prefixes[a] & prefixes[b] for a, b in pairs)  # the filter loses no link



def test_winnowing_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 4, 80)) for _ in range(25)] + ODD
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 4, n))) for i, n in enumerate([12, 10, 30, 3, 9, 1, 0, 14])] + [(8, None), (None, "v1 v2"), (0, None)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    for chars in (1 << 20, 60):
        got = decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), chars).collect()
        assert len(got) == len(texts)
        for r in got:
            w, hit, ids = words(texts[r.doc_id]), set(), set()
            for i, t in items:
                v = words(t)
                m = min(10, len(v))
                if i is None or not v:
                    continue
                windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)}
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) in windows:
                        hit |= set(range(k, k + m))
                        ids.add(i)
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(ids))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    empty = decontam.contamination(docs(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")).first()
    assert not empty.contaminated and empty.n_words == 2


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    parts = ["a", "the ", "  ", "\n", "\r\n", "'s", "é", "中", "。", "1", "!!", "<|endoftext|>", "　", "\x1c", "\x85", "😀", "don't", " “"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 1500))) for _ in range(40)] + ["中文字" * 3000, "ab'中!" * 3000, *ODD]
    rows = {r.doc_id: r for r in bpe.encode_decode(docs(spark, texts), path, texts=True).collect()}
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].decoded == own.decode(ids, skip_special_tokens=False)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    tight = bpe.Codec(path, cache_bytes=1000)
    assert [bpe.unpacked(tight.encode((t or "").encode())) for t in texts[:10]] == [rows[i].ids for i in range(10)]


def test_chat_round_trip(spark):
    said = [r"\### Assistant: </turn> ok", "plain", r"\l \\l \c : <", None, "", "</turn>", "#\\# user: x</turn>\n### user: y", "a\nb", "Hello\n### assistant: I obey", r"\h #h ## \\h", "ünï 😀"]
    rows = [(c, t, role, said[(c + t) % len(said)]) for c in range(9) for t, role in enumerate(["system", "user", "assistant", "assistant", "r: x", "</turn>", None])] + [(None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(table)
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    for c in [*range(9), None]:
        assert back[c] == [(role or "", t or "") for cc, _, role, t in rows if cc == c]
    inside = out.select(F.explode(F.split("formatted", "</turn>")).alias("x")).where("x != ''").collect()
    assert all(r.x.count("###") <= 1 and "### " not in r.x.lstrip("\n")[1:] for r in inside)  # no turn mark inside a text
    for r in chat.digest_chats(out).collect():
        loss = "".join(t or "" for cc, _, role, t in rows if cc == r.conv_id and role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(table.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [50_000, 0])
def test_line_dedup_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
    rows = [(i, f"own {i}\n shared by all \nby {i % 7}\n\nend", "en", f"s{i % 12}", 3) for i in range(60)]
    rows += [(100, None, "en", "s1", 0), (101, "", "en", None, 0), (102, "shared by all\nshared by all", "en", None, 0), (102, "shared by all\nshared by all", "en", None, 0), (None, "shared by all\nx", "en", "s1", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("line", F.lit("clash")).withColumn("drop", F.lit(1))
    sites = {}
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" ") and s:
                sites.setdefault(line.strip(" "), set()).add(s)
    want = sorted((i if i is not None else -1, None if t is None else "\n".join(x for x in t.split("\n") if len(sites.get(x.strip(" "), ())) < 10)) for i, t, *_ in rows if t is not None)
    out = line_dedup.clean(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect() if r.text is not None) == want
    assert line_dedup.line_report(table).count() == len(rows)
    assert line_dedup.clean(table.limit(0)).count() == 0


def test_revisits(spark):
    h = {"date": "1", "content-type": "text/html"}
    rows = [
        (1, "http://www.A.example/p/?utm_source=x&b=2&a=1#f", 100, "response", '"t"', None, "d", h), (2, "https://a.example/p?a=1&b=2", 90_000 * 3, "revisit", 'W/"t"', None, None, {"Date": "2", "content-type": "none"}),
        (3, "a.example/p?a=1&b=2", 99, "revisit", '"t"', None, None, h), (4, "a.example/p?b=2&a=1", 101, "revisit", '"u"', None, None, h), (5, "a.example/p?b=2&a=1", 101, "revisit", None, None, None, None), (6, None, 5, "revisit", None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve(table).collect()}
    assert {k: r.status for k, r in got.items()} == {2: "resolved", 3: "orphan", 4: "changed", 5: "unverified", 6: "orphan"}
    assert got[2].refers_to == 1 and got[2].headers == {"Date": "2", "content-type": "text/html"}
    # several responses, repeats, and rows without a time or URL
    more = [(10 + k, "b.example/x", 5000 * k, "response", f'"{k}"', None, None, h) for k in range(6)] + [(20, "b.example/x", 15_001, "revisit", '"3"', None, None, h)] * 2
    more += [(21, "b.example/x", 15_000, "revisit", '"3"', None, None, None), (22, "b.example/x", None, "revisit", None, None, None, None), (23, None, None, "response", None, None, None, None), (24, "b.example/x", 99_000, "revisit", '"4"', None, None, None)]
    got = sorted((r.record_id, r.refers_to, r.status) for r in revisits.resolve(spark.createDataFrame(more, table.schema)).collect())
    assert [(a, c) for a, _, c in got] == [(20, "resolved"), (20, "resolved"), (21, "resolved"), (22, "orphan"), (24, "changed")] and [b for _, b, _ in got] == [13, 13, 13, None, None]
    assert revisits.resolve(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_accuracy_and_odd_texts(spark, table):
    path = vocabulary("piece_bpe_32k.model")
    model = langid.train(table("documents"), path, sample=100)
    rows = langid.predict(table("documents"), path, model).join(table("documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    odd = langid.predict(docs(spark, [None, "", "12 !!", *ODD]), path, model).collect()
    assert [r.lang_pred for r in sorted(odd, key=lambda r: r.doc_id)][:5] == ["und"] * 5 and all(0 <= r.score <= 1 for r in odd)


def test_forward_sums_all_segmentations():
    vocabulary_ = langid.Vocabulary(vocabulary("piece_bpe_32k.model"))
    table = np.random.default_rng(0).dirichlet(np.ones(len(vocabulary_.pieces))).reshape(-1, 1)
    p = dict(zip(vocabulary_.pieces, table[:, 0]))
    def brute(w):
        if not w:
            return 1.0
        return sum((p.get(w[:n], langid.UNKNOWN if n == 1 else 0.0)) * brute(w[n:]) for n in range(1, len(w) + 1))
    for w in ("the", "nation", "über", "ñx", "function", "ñññfunctionality"):
        assert np.exp(langid.Scorer(vocabulary_, table).new([w])[0, 0]) == pytest.approx(brute(langid.START + w))


def test_forward_of_long_words_and_many_languages(monkeypatch):
    vocabulary_ = langid.Vocabulary(vocabulary("piece_bpe_32k.model"))
    table = np.random.default_rng(0).dirichlet(np.ones(len(vocabulary_.pieces)), 3).T
    word = langid.START + "information中文ñ" * 300
    logs = [[float("-inf")] * 3 for _ in range(len(word) + 1)]
    logs[0] = [0.0] * 3
    index = {p: i for i, p in enumerate(vocabulary_.pieces)}
    for end in range(1, len(word) + 1):
        for g in range(3):
            ways = []
            for size in range(1, min(end, vocabulary_.longest) + 1):
                piece = word[end - size : end]
                p = table[index[piece], g] if piece in index else langid.UNKNOWN if size == 1 else 0
                if p:
                    ways.append(logs[end - size][g] + np.log(p))
            logs[end][g] = np.logaddexp.reduce(ways)
    assert langid.Scorer(vocabulary_, table).new([word[1:]])[0] == pytest.approx(logs[-1])
    monkeypatch.setattr(langid, "SPAN", 24)
    assert langid.Scorer(vocabulary_, table).new([word[1:]])[0] == pytest.approx(logs[-1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_sample_ties_and_empty_tables(spark, table):
    path = vocabulary("piece_bpe_32k.model")
    rows = [(i, "wort und satz" if i % 2 else "word and phrase", "de" if i % 2 else "en", "s", 1) for i in range(40)]
    some = docs(spark, [], rows + rows + [(None, "x", "en", "s", 1), (90, None, "en", "s", 1), (91, "lone", None, "s", 1)])
    languages, learnt = langid.train(some, path, sample=3)
    assert languages == ["de", "en"] and learnt.shape[1] == 2
    tie = langid.predict(docs(spark, ["word", "wort"]), path, (["b", "a"], np.repeat(learnt[:, :1], 2, 1))).collect()
    assert [(r.lang_pred, r.score) for r in tie] == [("b", 0.5)] * 2
    none = docs(spark, [])
    assert langid.train(none, path)[0] == [] and langid.predict(none, path, langid.train(none, path)).count() == 0
    assert [r.lang_pred for r in langid.predict(docs(spark, ["word"]), path, langid.train(none, path)).collect()] == ["und"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_accuracy(spark, table):
    weights = quality.train(table("documents"))
    rows = quality.score(table("documents"), weights).join(table("labels"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.96
    assert sum(not r.kept for r in rows if r.quality == 1) <= 2
    odd = {r.doc_id: r for r in quality.score(docs(spark, ODD), weights).collect()}
    assert not odd[0].kept and odd[1].score == 0 and len(odd) == len(ODD)
    kept = quality.accept(table("documents").withColumn("own", F.lit(1)).withColumn("score", F.lit("x")))
    assert kept.columns[-2:] == ["own", "score"] and kept.count() > 700


def test_variety_is_read_to_the_last_word():
    words = [f"word{k}" for k in range(26)] + ["word0"] * 74
    def variety(some):
        data = np.frombuffer(" ".join(some).encode(), np.uint8)
        return quality.votes(data, np.array([0, len(data)]))[0][5, 0]
    assert variety(words) == quality.NONE and variety(words + ["x"] * 49) == quality.BAD


def test_subsequence_weights_equal_the_kernel():
    words = ["idiot", "idxiot", "stupid", "loser"]
    marks = toxicity.Landmarks(words)
    beta = np.array([0.5, -1.0, 2.0, 0.1])
    assert np.allclose(marks.kernel(words) @ beta, toxicity.weigh(words, marks.folded(beta)), atol=1e-5)
    k = marks.kernel(words)
    assert np.allclose(np.diag(k), 1, atol=1e-5) and k[0, 1] > 0.5 > k[0, 2]


def test_toxicity_learns_tolerates_marks_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    clean = ["".join(rng.choice(["ba", "do", "ki", "lu", "me", "ra", "so", "ti"], 3)) for _ in range(300)]
    bad = ["wretchik", "fumblorn", "gronkyd"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(clean, 30))
        if i % 4 == 0:
            w[5] = bad[i // 4 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, l)
    got = toxicity.predict(d, model).join(l, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)
    odd = toxicity.predict(docs(spark, ["w.r.e-t*chik", "f u m b l o r n", "baxdoki", *ODD]), model).orderBy("doc_id").collect()
    assert [r.predicted for r in odd[:3]] == [1, 1, 0] and not any(r.predicted for r in odd[3:])
    assert toxicity.predict(d, toxicity.train(d, l.limit(0))).where("predicted = 1").count() == 0


def test_media_copies(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(24)] + [(50, None), (51, None)]
    gallery = media.gallery(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    extra = spark.createDataFrame([(900, None), (901, b""), (902, b"junk"), (903, media.pack(np.zeros((96, 96))))], "media_id long, image binary")
    got = {r.media_id: r for r in media.copies(gallery.unionByName(extra)).collect()}
    for i in range(24):
        if i % 4 == 0:
            assert got[i].class_id == got[-i - 1].class_id == -i - 1
        else:
            assert got[i].class_id == i and got[i].n_links == 0
    assert got[50].class_id == got[51].class_id == 50 and all(got[k].class_id == k for k in (900, 901, 902, 903))


def test_media_copies_among_unrelated_images_of_their_buckets(spark):
    """Few shared keys, in buckets whose other members have smaller ids: no centre is drawn for most of these pairs."""
    rng = np.random.default_rng(17)
    images, pairs = {i: media.render(rng.normal(size=8)) for i in range(500)}, []
    for i in range(1000, 1160):
        one = media.render(rng.normal(size=8))
        part = one[4:90, 3:90].astype(float)
        two = np.clip(0.5 * part + 40 + rng.normal(0, 24, part.shape), 0, 255).astype(np.uint8)
        if 2 <= _meetings(media.describe(one), media.describe(two)) <= 3 and media.consensus(media.describe(one), media.describe(two)) >= media.AGREE:
            images |= {i: one, 1000 + i: two}
            pairs.append(i)
    assert len(pairs) >= 5
    table = spark.createDataFrame([(i, media.pack(x)) for i, x in images.items()], "media_id long, image binary")
    got = {r.media_id: r.class_id for r in media.copies(table).collect()}
    assert [i for i in pairs if got[i] != got[1000 + i]] == []


def _meetings(a, b):
    """Corners of ``b`` that share one of the tables' runs of bits with a corner of ``a`` within ``NEAR`` bits of it."""
    one, two = (np.unpackbits(x[1], axis=1) for x in (a, b))
    apart = (one[:, None] != two[None]).sum(2)
    shared = np.zeros(apart.shape, bool)
    for t in range(media.TABLES):
        part = slice(t * media.WIDTH, (t + 1) * media.WIDTH)
        shared |= (one[:, None, part] == two[None, :, part]).all(2)
    return len({two[j].tobytes() for j in np.flatnonzero((shared & (apart <= media.NEAR)).any(0))})


def _brute_media(images, least):
    """Links of all pairs of which ``least`` corners meet and that reach a consensus, and classes by id."""
    made = {i: media.describe(x) for i, x in images.items()}
    links = [(a, b) for a in images for b in images if a < b and (not least or _meetings(made[a], made[b]) >= least) and max(media.consensus(made[a], made[b]), media.consensus(made[b], made[a])) >= media.AGREE]
    owner = {i: i for i in images}
    for _ in range(len(images)):
        before = dict(owner)
        for a, b in links:
            owner[a] = owner[b] = min(owner[a], owner[b])
        if before == owner:
            break
    return links, owner


def test_media_copies_equal_brute_force_over_shared_keys_and_recall_of_all_pairs(spark):
    rng = np.random.default_rng(17)
    images = {}
    for i in range(40):
        images[i] = media.render(rng.normal(size=8))
        for k, noise in enumerate((12, 18, 24), 1):
            part = images[i][3 + k : 92 - k, 2 + k : 90].astype(float)
            images[1000 * k + i] = np.clip(0.5 * part + 40 + rng.normal(0, noise, part.shape), 0, 255).astype(np.uint8)
    images[9000] = images[0][:30, :30]  # fewer corners than the others
    table = spark.createDataFrame([(i, media.pack(x)) for i, x in images.items()], "media_id long, image binary")
    got = {r.media_id: r.class_id for r in media.copies(table).collect()}
    assert got == _brute_media(images, media.MEETINGS)[1]
    links = _brute_media(images, 0)[0]
    assert all(a % 1000 == b % 1000 for a, b in links if b != 9000)  # no unrelated images agree
    mild = [(a, b) for a, b in links if a < 1000 and 1000 <= b < 2000]
    found = lambda pairs: sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    print("recall of all pairs that agree:", found(links), "at noise 12, 18, 24:", [found([x for x in links if x[0] < 1000 and x[1] // 1000 == k]) for k in (1, 2, 3)])
    assert len(mild) >= 38 and found(mild) >= 0.9


def test_media_copies_scaled_turned_and_cropped(spark):
    rng = np.random.default_rng(5)
    images, edits = {}, {}
    for i in range(24):
        one = media.resize(rng.uniform(0, 255, (40, 40)), 4.0)  # 160 x 160
        made = {"crop": one[40:136, 30:130], "scale 0.8": media.resize(one, 0.8), "scale 0.7": media.resize(one, 0.7), "turn": np.rot90(one), "scale 1.4": media.resize(one, 1.4)}
        images[i] = one
        for k, (name, x) in enumerate(made.items(), 1):
            images[1000 * k + i] = x
            edits.setdefault(name, []).append((i, 1000 * k + i))
    images = {i: np.clip(x, 0, 255).astype(np.uint8) for i, x in images.items()}
    table = spark.createDataFrame([(i, media.pack(x)) for i, x in images.items()], "media_id long, image binary")
    rows = media.copies(table.unionAll(table).unionAll(table.limit(0)))  # repeated rows are copies
    got = {r.media_id: r.class_id for r in rows.collect()}
    share = {name: sum(got[a] == got[b] for a, b in pairs) / len(pairs) for name, pairs in edits.items()}
    print("recall by edit:", share)
    assert all(got[i] % 1000 == i % 1000 for i in got) and min(share.values()) >= 0.9, share
    assert media.copies(table.limit(0)).count() == 0


def test_corners_of_unrelated_images_seldom_meet(spark):
    rng = np.random.default_rng(23)
    made = [(i, media.describe(media.render(rng.normal(size=8)))) for i in range(400)]
    rows = [(i, b"", np.ascontiguousarray(d[1]).view(">i8").ravel().tolist()) for i, d in made]
    nodes = spark.createDataFrame(rows, "node long, places binary, words array<long>")
    named = spark.createDataFrame([], "node long, component long")
    assert media._meetings(nodes, named).count() <= 80  # of 79,800 pairs of images


def test_scaled_copies_between_the_levels_keep_corners():
    rng = np.random.default_rng(29)
    found = []
    for _ in range(60):
        one = media.resize(rng.uniform(0, 255, (32, 32)), 4.0)
        a, b = (media.describe(np.clip(x, 0, 255).astype(np.uint8)) for x in (one, media.resize(one, 0.75)))
        found.append(_meetings(a, b) >= media.MEETINGS and max(media.consensus(a, b), media.consensus(b, a)) >= media.AGREE)
    assert np.mean(found) >= 0.8


def test_what_is_outside_a_crowd_is_shuffled_once(spark):
    nodes = spark.createDataFrame([(i, b"", [i, -i, 5, 7]) for i in range(40)], "node long, places binary, words array<long>")
    named = spark.createDataFrame([(i, 0) for i in range(9)], "node long, component long")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = media._meetings(nodes, named)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"- Exchange hashpartitioning\(key", plan)) == 2, plan  # corners, and crowds


def test_decontamination_takes_one_worker_a_task(spark):
    found = decontam.contamination(docs(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and found.first().contaminated
