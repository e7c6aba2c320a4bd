"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

import public_tokenizers
from bracken.llm import _kit as kit, bpe, jaccard, jpeg, licenses, packing, quality, runindex, substring, toxicity, wrappers


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s


def _rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    base = [" ".join(word() for _ in range(120)) for _ in range(4)]
    rows = [(i, " ".join(word() for _ in range(40)) + " " + passage + "\n" + " ".join(word() for _ in range(30))) for i in range(6)]
    for i, b in enumerate(base):
        rows.append((10 + i, b))
        rows.append((20 + i, b + " extra"))
    rows += [(30, base[0]), (31, base[0]), (31, base[0]), (32, None), (33, ""), (34, "a b"), (35, "a b"), (36, "x " * 3000), (37, "aaaa" * 500), (None, base[1]), (38, " \n\t "), (39, passage)]
    return [(d, t, "tie", 1) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), "doc_id long, text string, block string, node int")


def _repeats(tokens_of, window):
    rows = [(d, tokens_of(t or "")) for d, t, *_ in _rows()]
    first = {}
    for d, w in rows:
        for j in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in rows:
        cover = [False] * len(w)
        for j in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[j : j + window])] < d:
                cover[j : j + window] = [True] * window
        out.append((d, w, cover))
    return out


def test_substring_dedup(spark, docs):
    got = Counter(map(tuple, substring.anchors.remove_repeats(docs, substring._plan(substring._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")).collect()))
    want = Counter((d, len(w), sum(c), hashlib.sha256(b" ".join(x for x, y in zip(w, c) if not y)).hexdigest()) for d, w, c in _repeats(lambda t: t.encode().split(), 50))
    assert got == want


def test_substring_texts_keep_columns(docs):
    got = substring.dedup_texts(docs)
    assert got.columns == docs.columns and got.count() == docs.count()


def test_suffix_dedup(docs):
    got = Counter(map(tuple, runindex.anchors.remove_repeats(docs, runindex._plan(runindex._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")).collect()))
    want = Counter((d, len(w), sum(c), len(re.findall("1+", "".join("01"[x] for x in c))), hashlib.sha256(bytes(x for x, y in zip(w, c) if not y)).hexdigest()) for d, w, c in _repeats(lambda t: list(t.encode()), 50))
    assert got == want


def test_run_index_statistics():
    rnd = random.Random(1)
    for _ in range(40):
        texts = [bytes(rnd.randint(1, 3) for _ in range(rnd.randint(1, 90))) for _ in range(rnd.randint(1, 5))]
        q = bytes(rnd.randint(1, 4) for _ in range(50))
        index = runindex.RunIndex(np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8), 90)
        got = np.zeros(50, int)
        for _, place, size, _ in index.statistics(np.frombuffer(q, np.uint8), np.array([0]), np.array([50])):
            got[place] = size
        want = [max(n for n in range(51 - i) if any(q[i : i + n] in t for t in texts)) for i in range(50)]
        assert got.tolist() == want


def test_jaccard(docs):
    rows = [(d, (t or "").split()) for d, t, *_ in _rows()]
    sets = [None if d is None else frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for d, w in rows]
    link = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = [d for d, _ in rows]
    for _ in rows:
        label = [min([label[i]] + [label[j] for j in range(len(rows)) if link[i][j]]) if label[i] is not None else None for i in range(len(rows))]
    want = Counter((d, label[i], sum(link[i])) for i, (d, _) in enumerate(rows))
    assert Counter(map(tuple, jaccard.jaccard_classes(docs).collect())) == want


def test_packing(docs):
    got = packing.pack(packing.pieces(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text, *_ in _rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_bpe(docs):
    r = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter()
    for d, t, *_ in _rows():
        ids = r.encoding.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip_digests(docs).collect())) == want
    assert {bytes(x.bytes).decode() for x in bpe.decode(bpe.encode(docs)).collect()} == {t or "" for _, t, *_ in _rows()}


def test_bpe_chunks():
    import regex

    pattern, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    parts = ["a", " ", "  ", "\n", "12", "'s", "'re", "'", "!!", "é", "漢", " " * 7, "x" * 9, "\x1c"]
    for _ in range(500):
        t = "".join(rnd.choice(parts) for _ in range(40))
        cp = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        assert bpe.stitched(cp, rnd.randint(1, 12), rnd.randint(1, 6)).tolist() == [m.start() for m in pattern.finditer(t)]


def test_licenses(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "CC-BY 4.0 and cc by; GNU General Public License"), (3, None), (4, "the mit licenses"), (5, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels) == (1, 3, "apache") and got[1].score > 0.9
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 7, "cc-by,gpl")
    assert got[3].n_words == 0 and got[3].first_word is None and got[4].n_base == 0 and got[5].labels == ""
    assert len(licenses.rules()) > 230


def test_quality_counts(docs):
    model = quality.fit_model([], [])
    want = Counter()
    for d, t, *_ in _rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.split()]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed, not failed] += 1
    assert Counter(tuple(r)[:8] for r in quality.judge(docs, model).collect()) == want


def test_toxicity_restores_and_holds_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = kit.table(spark, d, "documents"), kit.table(spark, d, "labels")
    counts = toxicity.letter_counts(docs)
    model = toxicity.train(docs, labels, counts)
    got = toxicity.scores(docs, model, counts).join(labels, "doc_id").where("held_out").toPandas()
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert clean.predicted.mean() < 0.01 and toxic.predicted.mean() > 0.5
    assert toxicity.scores(docs.limit(0), model, counts).count() == 0
    channel = toxicity.Channel(np.ones(toxicity.ALPHABET**3, np.int64))
    assert channel.restore("l.o.s.e.r") == "loser"


def test_jpeg_round_trip():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 576, 700, 20_000):
        p = jpeg.padded(rnd.integers(0, 256, n, np.uint8).tobytes())
        image = jpeg.Image(jpeg.encode(p))
        assert jpeg.payload(image) == p and image.rgb().shape == (image.height, image.width, 3)
    file = jpeg.encode(jpeg.padded(b"slow path"))
    fast, jpeg.Image._fast = jpeg.Image._fast, lambda *a: False
    try:
        slow = jpeg.Image(file)
    finally:
        jpeg.Image._fast = fast
    assert all((a == b).all() for a, b in zip(slow.coefficients, jpeg.Image(file).coefficients))


def test_wrappers(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four<div class='ad'>buy</div>{}</article><footer>f</footer></body></html>"
    rows = [(1, "http://a.b/1", page.format("")), (2, "http://a.b/2", page.format("<p>five</p>")), (3, None, None), (4, "http://a.b/3", "<p>bare")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_pages(pages, wrappers.learn(pages)).collect()}
    assert got == {1: "A & B\none two three\nfour", 2: "A & B\none two three\nfour\nfive", 3: "", 4: "bare"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not jaccard.jaccard_classes(none).count() and not substring.dedup_texts(none).count() and not packing.pack(packing.pieces(none)).count()


def test_wrappers_fixed_texts(spark):
    # The disclaimer has no listed tag or class; it stands on every page of its host, in a run of paragraphs like it.
    page = "<body><div><h1>Title {0}</h1><p>first {0}</p><p>Terms &amp; <b>conditions</b> apply.</p><p>second {0}</p></div></body>"
    rows = [(i, f"http://t.a/{i}", page.format(i)) for i in range(4)] + [(9, "http://u.a/", page.format(9)), (10, "http://u.a/copy", page.format(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    learnt = wrappers.learn(pages)
    got = {r.page_id: r.text for r in wrappers.extract_pages(pages, learnt).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i}\nfirst {i}\nsecond {i}" for i in range(4)]
    assert got[9] == got[10] == "Title 9\nfirst 9\nTerms & conditions apply.\nsecond 9"  # copies of one page tell nothing
    assert "=" in {r.host: r.wrapper for r in learnt.collect()}["t.a"]
    group = [c for c in "abcdefghijklmnop"]
    assert wrappers.fold(group * 3) == [("+", tuple(group))]


def test_wrappers_marks():
    for tag in ('<body class="no-sidebar">{}', '<div id="page" class="content-with-sidebar">{}</div>', '<article class="post has-header comment-open">{}</article>', '<main class="widget-area">{}</main>'):
        assert wrappers.extract(tag.format("<p>text</p>")) == "text", tag
    for tag in ('<body class="sidebar">{}', '<article class="alert">{}</article>', '<main class="widget">{}</main>', '<div class="widget"><article>{}</article></div>'):
        assert wrappers.extract(tag.format("<p>text</p>")) == "text", tag
    assert wrappers.extract('<div class="wide ad">buy</div><p>text</p>') == "text"
    assert wrappers.extract('<article><p>text</p></article><div class="comments"><article><p>me too</p></article></div>') == "text"
    assert wrappers.extract('<p>one <span class="ad">buy <span>now</span> here</span>two <a class="share" href="/">tell</a></p><p>three</p>') == "one two\nthree"
    assert wrappers.extract('<p>one <a class="share">tell</p><p>two</p>') == "one\ntwo"


def _example(pattern, rnd):
    """A string that a pattern matches, built from its parsed form."""
    from re import _parser

    def make(nodes):
        out = ""
        for op, arg in nodes:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                kind, x = arg[rnd.randrange(len(arg))]
                out += "x" if str(kind) in ("CATEGORY", "NEGATE") else chr(x if str(kind) == "LITERAL" else rnd.randint(*x))
            elif op == "ANY":
                out += "x"
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(make(arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], max(1, arg[0] + 1)))))
            elif op == "SUBPATTERN":
                out += make(arg[3])
            elif op == "BRANCH":
                out += make(rnd.choice(arg[1]))
            else:
                assert op == "ASSERT_NOT", op
        return out

    return make(_parser.parse(pattern.pattern))


def test_license_rules_pass_their_gate(spark):
    rnd = random.Random(3)
    for rule in licenses.rules():
        shown = [" ".join(_example(rule.pattern, rnd).split()) for _ in range(40)]
        held = licenses.held_keywords(kit.Words(*kit.utf8(pa.array(shown))))
        for i, text in enumerate(shown):
            assert rule.pattern.fullmatch(text), (rule, text)
            assert set(rule.keywords) <= held.get(i, set()), (rule, text)
    glued = {"GPLv3": "gpl", "LGPLv2": "lgpl", "AGPLv3": "agpl", "MPL2": "mpl", "EPL2": "epl", "Apache2": "apache", "the Unlicence": "unlicense", "Open RAIL": "openrail", "GPL2": "gpl"}
    rows = [(i, f"Licensed under {x}.") for i, x in enumerate(glued)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [(x, 0.97) for x in glued.values()]


def test_packing_added_tokens(spark):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end * 2, f" {end} ", "<|endof", "text|>", f"x  {end}  y", "", f"é{end}漢{end}", "plain", None, f"{end}tail", f"head{end}"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 50256, 65]
    ids, first = packing.encode_rows(own, pa.array(texts), packing.added_tokens(t))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), carry=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: [*x, packing.END] for i, x in enumerate(want)}


def test_toxicity_decodes_signs_anywhere():
    plain = " ".join(["asshole ass shit hole loser idiot the hit"] * 400)
    cp = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    c = toxicity._codes()[cp].astype(np.int64)
    counts = np.bincount(c[:-2] * toxicity.ALPHABET**2 + c[1:-1] * toxicity.ALPHABET + c[2:], minlength=toxicity.ALPHABET**3)
    channel = toxicity.Channel(counts)
    rows = {"a$$": "ass", "sh!7": "shit", "@$$hole": "asshole", "@ss": "ass", "lo$€r,": "loser", "£oser": "loser", "los€": "lose", "i - d - i - 0 - t": "idiot", "é t é": "été"}
    got = toxicity.restored(*kit.utf8(pa.array(rows)), channel)
    for i, (text, want) in enumerate(rows.items()):
        assert want in [x for r, x in got if r == i], (text, got)
    assert not toxicity.restored(*kit.utf8(pa.array(["hit! (the hole), loser.", None, "", "- - - -"])), channel)


def _thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") & 1) ^ swap] for i in range(n))


def test_words_with_equal_polynomials_are_told_apart(spark):
    """The Thue-Morse word and its complement have equal sums modulo 2**64, whatever the base."""
    a, b = _thue_morse(4096), _thue_morse(4096, True)
    h = kit.span_hashes(*(lambda x: (x[0], x[1][:-1], x[1][1:]))(kit.utf8(pa.array([a, b]))))
    assert h[0] != h[1]
    rows = [(1, a), (2, b), (3, f"{a}\n{b}\n{a}"), (4, " ".join([a] * 60)), (5, " ".join([b] * 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {x.doc_id: x for x in bpe.round_trip_digests(docs).collect()}
    for d, t in rows:
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, r.encoding.encode_ordinary(t))).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {x.doc_id: x.n_dup_lines for x in quality.judge(docs, quality.fit_model([], [])).collect()}[3] == 1
    plan = substring._plan(substring._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert {x.doc_id: x.n_removed for x in substring.anchors.remove_repeats(docs, plan).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_kinds_compares_bytes():
    buf, off = kit.utf8(pa.array(["aa", "bb", "aa", "", "c" * 999, "c" * 999, "", "bb"]))
    for h in (None, np.zeros(8, np.uint64)):  # all hashes alike: the bytes decide
        at, which = kit.kinds(buf, off[:-1], off[1:], h)
        assert len(at) == 4 and which[0] == which[2] and which[1] == which[7] and which[3] == which[6] and which[4] == which[5] and len(set(which.tolist())) == 4
        assert [which[i] for i in at] == list(range(4))
    w = kit.Words(*kit.utf8(pa.array(["x y x", None, "y"])))
    assert w.ids[0] == w.ids[2] and w.ids[1] == w.ids[3] and w.ids[0] != w.ids[1]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(20)]
    star = [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 3000) for i in range(5)]
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[1000 + i] for i in range(40)} == {1000} and got[3000] == 2000
    assert not jaccard.components(spark.createDataFrame([(1, 1)], "a long, b long")).count()


def test_one_row_of_each_class_stays(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join(words[:-1] + ["z"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "x"), (1, a, "y"), (2, near, "x"), (2, other, "x"), (3, None, "x"), (3, "", "x"), (None, a, "x"), (4, other, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_first(docs).collect())
    assert got == Counter([(1, a), (2, other), (3, None), (3, ""), (None, a)])
    plain = spark.createDataFrame([(1, a, 1), (2, near, 1), (5, other, 1)], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in jaccard.keep_first(plain).collect()) == [1, 5]


def test_wrappers_teasers():
    assert wrappers.extract("<aside><article>teaser</article></aside><main><p>Real text.</p></main>") == "Real text."
    assert wrappers.extract("<main><h1>T</h1><p>Real text of some length.</p><article>teaser</article></main>") == "T\nReal text of some length.\nteaser"
    assert wrappers.extract("<main><article><div class='article-header'><h1>T</h1></div><p>text</p></article><p>more</p></main>") == "T\ntext"


def test_wrappers_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 2)
    rows = [(i, "http://h.a/x", "<body><div>" + "<p>a</p><ul><li>b</ul>" * (i % 3 + 1) + f"<h{i % 5 + 1}>t{i}</h{i % 5 + 1}></div>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    learnt = wrappers.learn(pages)
    assert learnt.count() == 1
    sent = wrappers.extract_pages(pages, learnt).collect()
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, wrappers.extract_pages(pages, wrappers.learn(pages)).collect())) == Counter(map(tuple, sent))


def test_license_base_against_brute_force(docs):
    rows = _rows() + [(50, "The MIT License, mit  license; CC-BY cc by " * 400, "tie", 1), (51, "Apache\nLicense", "tie", 1)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs.sparkSession.createDataFrame(rows, docs.schema)).collect())
    want = Counter()
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in hits]
        want[d, len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert got == want


def test_media_digests_and_tensors(docs):
    got = jpeg.digests(docs).collect()
    want = Counter()
    for d, t, *_ in _rows():
        raw = (t or "").encode()
        stored = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[d, len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = {}
    for r, (_, t, *_) in zip(sorted(got, key=lambda r: (r.payload_sha256)), sorted(_rows(), key=lambda x: str(x[1]))):
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in same.values())
    for r in jpeg.tensors(docs.where("doc_id in (10, 32, 36)")).collect():
        assert len(r.rgb) == r.height * r.width * 3 and r.rgb == jpeg.Image(bytes(r.jpeg)).rgb().tobytes()


def test_quality_fit_tells_classes_apart():
    rnd = random.Random(4)
    good = [" ".join(rnd.choice("river stone garden winter letter".split()) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rnd.choice("click buy cheap now offer".split()) for _ in range(40)) for _ in range(150)]
    model = quality.fit_model(good[:120] + bad[:120], [1] * 120 + [0] * 120)
    p = quality._probability(model, quality.raw_scores(model, *kit.utf8(pa.array(good[120:] + bad[120:] + [""]))))
    assert (p[:30] >= quality.KEEP_FROM).all() and (p[30:60] < quality.KEEP_FROM).all()


def test_odd_tables_do_not_stop_any_operator(spark, docs):
    """Nulls, empty texts, repeats and clashing columns: a row for each row, equal rows alike; an empty table: no rows."""
    labels = spark.createDataFrame([(d, i % 2, i % 2) for i, (d, *_) in enumerate(_rows())] + [(None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    counts = toxicity.letter_counts(docs)
    tox, good = toxicity.train(docs, labels, counts), quality.train(docs, labels)
    runs = [licenses.scan, jpeg.digests, bpe.round_trip_digests, lambda d: quality.judge(d, good), lambda d: toxicity.scores(d, tox, counts)]
    for run in runs:
        got = run(docs).collect()
        assert len(got) == len(_rows()) and len(set(x for x in got if x.doc_id == 31)) == 1
        assert run(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, "<p>a", 1), (1, None, "<p>a", 1), (None, "", None, 1), (2, "x", "", 2)], "page_id long, url string, html string, host int")
    got = wrappers.extract_pages(pages, wrappers.learn(pages)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert wrappers.extract_pages(pages.limit(0), wrappers.learn(pages.limit(0))).count() == 0


def test_pipeline_keeps_what_no_stage_rejects(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    clean = [text(80) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    passage = text(60)
    rows += [(20, clean[0], "en", "s", 1), (21, clean[1] + " more", "en", "s", 1), (22, "too short", "en", "s", 9), (23, "x " * 90, "en", "s", 1), (24, None, None, None, None), (25, text(40) + " " + passage, "en", "s", 1), (26, text(40) + " " + passage, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(12), 25, 26}  # without labels the models reject nothing
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cut = dict((i, x) for i, x, *_ in rows)
    cut[26] = " ".join(cut[26].split()[:40])  # the passage that document 25 has
    assert {r.doc_id: r.length for r in got} == {i: len(t.encode(cut[i], add_special_tokens=False).ids) + 1 for i in (*range(12), 25, 26)}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and not out.count(), name


def _best_fit(lengths, capacity=1024):
    """Sequences that plain best fit takes, longest piece first."""
    import bisect

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += i == len(gaps) and gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("kind", ["tiny", "mixed"])
def test_packing_rounds(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 60)  # many partitions, so that left-over runs meet
    rnd = random.Random(7)
    lengths = {"any": [rnd.randint(1, 1024) for _ in range(700)], "tiny": [rnd.randint(1, 30) for _ in range(900)], "equal": [300] * 400, "mixed": [1024] * 20 + [2] * 300 + [rnd.randint(200, 700) for _ in range(300)]}[kind]
    rows = spark.createDataFrame([(i, 0, 0, n, 1) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(len(lengths)))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.02 * _best_fit(lengths) + 1


def test_bridges_are_a_stack():
    rnd = random.Random(8)
    for _ in range(200):
        pieces, slots = ({p: rnd.randint(0, 4) for p in range(6)} for _ in range(2))
        runs = packing.bridges(pieces, slots)
        number = lambda of, down: {(p, i): (base + (end - 1 - i if down else i - first)) for p, x in of.items() for first, end, base in x for i in range(first, end)}
        got = {v: k for k, v in number(runs[1], True).items()}
        want, free = {}, []
        for p in range(6):
            for i in range(pieces[p]):
                if free:
                    want[p, i] = free.pop()
            free += [(p, i) for i in range(slots[p])]
        assert {k: got[v] for k, v in number(runs[0], False).items()} == want
