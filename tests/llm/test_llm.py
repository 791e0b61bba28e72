"""The training-data operators against brute force, round trips and held-out labels on small inputs."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from threadloom.llm import common, decontaminate, html_text, line_dedup, media, mixing, ngram_join, quality, token_count, token_file, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "a", "\n\n", "é" * 3, "x " * 4000, "Same text here again.", "Same text here again.", "\U0001f600 中文  x"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 10] + [(5, 5), (3, 2)], "a long, b long")
    assert {r["node"]: r["component"] for r in common.components(edges).collect()} == {i: 0 if i <= 10 else 11 for i in range(21)}
    assert common.components(edges.limit(0)).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    written, count = common.written, []
    monkeypatch.setattr(common, "written", lambda *a, **k: count.append(a[1]) or written(*a, **k))
    path = spark.range(9_999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = common.components(path)
    assert found.agg(F.max("component"), F.count("*")).first() == (0, 10_000) and len(count) <= 20
    order = list(range(3_000))
    random.Random(3).shuffle(order)
    count.clear()
    found = common.components(spark.createDataFrame([(order[i], order[i + 1]) for i in range(2_999) if i != 1_000], "a long, b long"))
    want = {n: min(order[:1_001] if k <= 1_000 else order[1_001:]) for k, n in enumerate(order)}
    assert {r["node"]: r["component"] for r in found.collect()} == want and len(count) <= 60


def test_hot_keys_are_labelled_without_a_shuffle_of_their_rows(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "k long, v long")
    labels = rows.where("k is not null").groupBy("k").agg(F.min("v").alias("least"), F.count("*").alias("n"))
    least = {}
    for r in rows.collect():
        least[r["k"]] = min(least.get(r["k"], r["v"]), r["v"]) if r["k"] is not None else None
    got = common.joined_hot(rows, labels, ["k"], "n").collect()
    assert len(got) == 601 and all(r["least"] == least[r["k"]] for r in got)


def test_words_are_cut_at_ascii_space_only():
    assert common.words_of("a b\tc\x1cd \x0be") == ["a b", "c\x1cd", "e"]


def test_quality_learns_and_handles_odd_texts(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["tree", "river", "stone", "walks", "slowly", "green"]) for _ in range(rng.randint(20, 90))) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!!", "###", "$$$", "NOW!!", "|"]) for _ in range(rng.randint(5, 40))) for _ in range(150)]
    x, y = np.array([quality.statistics(t) for t in good + bad]), np.array([1] * 150 + [0] * 150)
    model = quality.fit_discriminant(x[::2], y[::2])
    p = model.score(x[1::2])
    assert ((p >= 0.5) == (y[1::2] == 1)).mean() > 0.97
    odd = model.score(np.array([quality.statistics(t or "") for t in ODD]))
    assert np.isfinite(odd).all() and ((odd >= 0) & (odd <= 1)).all()
    assert quality.fit_discriminant(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit_discriminant(x[:5], y[:5]).score(x[:1]).tolist() == [1.0]


def test_keep_good_passes_columns(spark):
    rows = docs(spark, ["fine words about rivers and trees."] * 20 + ["### $$$ !!!"] * 20).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_token_file_round_trip(spark, tmp_path):
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_file.VOCABULARY))
    texts = [*ODD, "It's <|endoftext|> X <|ENDOFTEXT|>", "ΑΣ straße Ünï 12ab, (c)"]
    place = str(tmp_path / "ids")
    token_file.write_tokens(docs(spark, texts), place, meta=("source",))
    got = {r["doc_id"]: r for r in token_file.read_tokens(spark, place, ("ids", "source")).collect()}
    at = 0
    for i, t in enumerate(texts):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"], got[i]["source"]) == (at, len(want), want, f"src{i % 3}")
        at += len(want)
    sums = {r["doc_id"]: r["ids_crc32"] for r in token_file.check_sums(spark.read.parquet(place)).collect()}
    assert sums[0] == zlib.crc32(np.array([2], "<u4").tobytes())
    files = [f for f in (tmp_path / "ids").iterdir() if f.suffix == ".parquet"]
    metas = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    columns = {metas[0].column(k).path_in_schema: metas[0].column(k) for k in range(metas[0].num_columns)}
    assert columns["n_tokens"].encodings[0].startswith("DELTA") and any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_column_index and columns["ids.list.element"].has_offset_index
    with pytest.raises(ValueError, match="clash"):
        token_file.encoded(docs(spark, ["a"]).withColumn("part", F.lit(1)), ("part",))
    token_file.write_tokens(docs(spark, ["a"]).limit(0), str(tmp_path / "none"))
    assert token_file.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_html_extraction():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a> <a>More</a></nav><div class="cookie-notice">We use cookies here</div>'
        "<article><h1>A &lt;b&gt; title</h1><p>First   para\n graph.<script>var a='</p>';</script><p>Second &amp; <b>bold</b> part.<br>Third.</p>"
        '<div class="ad"><b>Buy now</b></div><ul><li>one</li><li>two</li></ul></article><section class="comments"><p>nice article, I liked it very much</p></section><aside>Side</aside><form>Mail</form><footer>&copy; us</footer>'
    )
    assert html_text.extract(page) == "A <b> title\nFirst para graph.\nSecond & bold part.\nThird.\none\ntwo"
    for odd in ("", "<p>", "<nav>only menu</nav>", "<!-- x", "<script>x"):
        assert html_text.extract(odd) == ""
    assert html_text.extract("<article><p>cut off he") == "cut off he"
    assert html_text.extract("<article><p>" + "long words " * 50_000).count("long") == 50_000


def test_html_deep_nesting():
    import time

    def took(depth):
        page = "".join(f'<div class="x{i}"><span>menu{i}</span>' for i in range(depth)) + "<article><h1>A title</h1><p>" + "words of the article " * 30 * (depth // 100) + "</p></article>"
        began = time.perf_counter()
        assert html_text.extract(page).startswith("A title\nwords of the article")
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 40 * took(2_000)  # eight times the page; its square would be 64 times


def test_jaccard_components_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = list(ODD)
    for n in (6, 9, 14, 40, 150):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 20))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(80)) + " " + passage for _ in range(15)]
    sets = [set(s.tolist()) for s in ngram_join.shingle_sets([t or "" for t in texts])]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in range(len(texts)):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}
    kept = ngram_join.keep_one(docs(spark, texts).withColumn("component_id", F.lit(0)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if label[i] == i]


def test_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    for n in [*range(2, 60), 150, 400, 1500]:
        for _ in range(6):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            most = int(n * 15 / 185 * 2)
            b = np.concatenate([a[rng.integers(0, most + 1) :], rng.integers(0, 2**63, max(most // 2, 0)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)))


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 11 else None, "en", rng.choice(["b", "a", None, "c", "a", "a"]), 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    sized = df.select("doc_id", "source", mixing.word_count().alias("size"))
    rate = {r["source"]: r for r in mixing.rates(sized).collect()}
    size = {s: sum(len((t or "").split()) for _, t, _, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    weight, budget, target = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(size.values()), {}
    open_ = set(size)
    while True:
        left = budget - sum(2 * size[s] for s in size if s not in open_)
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        if not over:
            break
        open_ -= over
    target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 2 * size[s] for s in size}
    assert all(abs(rate[s]["target"] - target[s]) < 1e-6 and rate[s]["source_size"] == size[s] for s in size)
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    assert all(abs(taken[s] - target[s]) < 0.25 * target[s] + 40 for s in size)
    assert mixing.mix(df.withColumn("size", F.lit("mine"))).columns == [*df.columns, "size"]
    nameless = spark.createDataFrame([(None, f"{t or ''} {i}", lang, s, 0) for i, t, lang, s, _ in rows], DOCS)
    share = mixing.mix(nameless.where("source = 'c'").withColumn("source", F.lit("a")).unionByName(nameless.where("source = 'a'"))).count() / nameless.where("source in ('a', 'c')").count()
    assert 1.2 < share < 1.8  # one draw for all null ids would give a whole number
    assert mixing.mix(df.limit(0)).count() == 0 and sorted(r[0] for r in mixing.mix(df).select("doc_id").collect()) == sorted(r[0] for r in mixing.mix(df.repartition(7)).select("doc_id").collect())


def test_token_counts_match_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_count.VOCABULARY))
    rng = random.Random(5)
    letters = " \n\t'sdtmrvelXéß12!?.<|>中 ́\x85"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b<|endoftext|>", "they'll we've 'tis", "x" * 3000, " " * 700, "'r", "'re", "a'"]
    assert token_count.Transducer(public_tokenizers.path(token_count.VOCABULARY)).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_state_maps_compose():
    after, _ = token_count.compile_splitter()
    rng = np.random.default_rng(6)
    classes = rng.integers(0, token_count.N_CLASSES, (7, 40)).astype(np.uint8)
    scanned = token_count.prefix_scan(token_count.chunk_maps(classes, after))
    for start in range(token_count.N_STATES):
        state = start
        for k, row in enumerate(classes):
            for c in row:
                state = after[state * token_count.N_CLASSES + c]
            assert scanned[k][start] == state


def test_toxicity_by_compression():
    rng = random.Random(7)
    calm = ["river", "stone", "green", "walks", "slowly", "under", "trees", "light", "morning", "water", "people", "quiet"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) + rng.choice(["", "s", "ly", "ing"]) for _ in range(rng.randint(30, 150))]
        if i % 4 == 0:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "blockhead", "nitwit"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit_distance(texts[:300], labels[:300])
    pair = model.compressors()
    p = model.score([model.summary(model.evidence(t, *pair)) for t in texts[300:]])
    y = np.array(labels[300:])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95
    odd = model.score([model.summary(model.evidence(t or "", *pair)) for t in ODD])
    assert np.isfinite(odd).all()
    assert toxicity.fit_distance([], []).constant == 0.5 and toxicity.fit_distance(["a"], [1]).constant == 1.0


def test_toxicity_fit_is_bounded_and_knows_repeated_ids(spark, monkeypatch):
    from zlib import crc32

    ids = [i for i in range(300) if crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids] + [(ids[0], "later text"), (ids[1], "z" * 5_000_000), (None, "x"), (ids[2], None)], "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_distance", lambda texts, marks: seen.append((texts, marks)))
    toxicity.fit(docs, labels)
    assert len(seen[0][0]) == len(ids) and seen[0][0][0] == "later text" and seen[0][0][1] == f"text of {ids[1]}" and seen[0][0][2] == "" and seen[0][1] == [i % 2 for i in ids]
    toxicity.fit(docs, labels, most_bytes=100)
    assert 0 < sum(len(t) for t in seen[1][0]) <= 100
    toxicity.fit(docs, labels.limit(0))
    assert seen[2] == ([], [])


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(99)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 12, 50)]
    texts = list(ODD)
    for _ in range(25):
        lines = []
        for _ in range(3):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ".join(w), " ".join(w).upper() + "!"]))
        texts.append("\n".join(lines))
    df = docs(spark, texts)
    norm = lambda x: " ".join(w for w in regex.split(r"[^\p{L}\p{N}]+", x.lower()) if w)
    lines = [(i, k, norm(x)) for i, t in enumerate(texts) if t for k, x in enumerate(t.split("\n")) if norm(x)]
    names = sorted({x for _, _, x in lines})
    label = {x: x for x in names}
    links = [(a, b) for a in names for b in names if a < b and distance(a, b) <= int(0.15 * max(len(a), len(b)) + 1e-9)]
    for _ in names:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    first, want = {}, {}
    for i, k, x in lines:
        if first.setdefault(label[x], (i, k)) != (i, k):
            want.setdefault(i, []).append(k)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(df).collect()}
    n_want = sum(map(len, want.values()))
    assert all(set(v) <= set(want.get(k, [])) for k, v in got.items()) and len(got) == len(texts)  # only near copies go
    assert sum(map(len, got.values())) >= 0.9 * n_want > 20
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df.withColumn("cut", F.lit(1)).withColumn("t", F.lit(2))).collect()}
    for i, t in enumerate(texts):
        assert left[i] == (t if not got[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup_finds_lines_with_a_changed_letter_or_word(spark):
    rng = random.Random(18)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 10))) for _ in range(400)]
    for n in (5, 8, 12, 20, 40, 90):
        texts = []
        for k in range(60):
            w = [rng.choice(vocabulary) for _ in range(n)]
            line, at = " ".join(w), rng.randrange(n)
            if k % 2 and len(w[at]) < 0.15 * len(line) - 1:
                w[at] = ""
                changed = " ".join(w)
            else:
                at = rng.randrange(len(line))
                changed = line[:at] + "z" + line[at + 1 :]
            texts += [line, changed]
        gone = {r["doc_id"] for r in line_dedup.dropped_lines(docs(spark, texts)).collect() if r["dropped"]}
        assert gone <= set(range(1, 120, 2)) and len(gone) >= 54, n


def test_line_dedup_keeps_texts_of_one_id_apart(spark):
    rows = [(1, "alpha beta\ngamma delta"), (5, "alpha beta\nunique line here"), (5, "my own first line\ngamma delta"), (5, "alpha beta\nunique line here"), (None, "gamma delta"), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert left == [(0, "gamma delta"), (0, "only here"), (1, "alpha beta"), (5, "my own first line"), (5, "unique line here"), (5, "unique line here")]


def test_line_dedup_meets_lines_that_share_one_frequent_shingle_alone(spark):
    rng = random.Random(24)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    start = [word() for _ in range(3)]
    texts = [" ".join([*start, *(word() for _ in range(rng.randint(2, 7)))]) for _ in range(150)]
    for _ in range(20):
        rest = [word() for _ in range(4)]
        texts += [" ".join([*start, *rest]), " ".join([*start, *("z" + w[1:] for w in rest)])]
    gone = {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(docs(spark, texts)).collect()}
    assert {k for k, v in gone.items() if v} == set(range(151, 190, 2))


def test_line_dedup_makes_each_pair_once(spark):
    rng = random.Random(25)
    rows = sorted({(rng.randrange(12), rng.randrange(40), rng.random() < 0.6) for _ in range(300)})  # a node may be own and guest under different keys
    rows = list({(key, h): (key, h, own) for key, h, own in rows}.values())
    rest = spark.createDataFrame([(key, h, 50, own, h // 3, None, None) for key, h, own in rows], "key long, h long, l int, own boolean, c long, sim long, n long")
    got = sorted((r["a"], r["b"]) for r in line_dedup._crossing(line_dedup._once(rest)).collect())
    meetings = [(a, b) for key, a, x in rows for other, b, y in rows if key == other and a < b and a // 3 != b // 3 and (x or y)]
    assert got == sorted(set(meetings)) and len(meetings) > 1.5 * len(got) > 100


def test_line_dedup_drops_the_lines_before_pairs_are_made(spark, monkeypatch):
    rng = random.Random(26)
    base = [f"w{rng.randrange(50)}" for _ in range(12)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(12)]
    made, write = {}, common.written

    def written(df, label, **options):
        if label == "line-pairs":
            assert not [x for x in made if "norm" in made[x].columns and x != "line-texts" and os.path.isdir(made[x].path)]
        made[label] = write(df, label, **options)
        made[label].path = made[label].inputFiles()[0].removeprefix("file://").rpartition("/")[0] if label == "line-lines" or "norm" in df.columns else ""
        assert not {"words", "keys"} & {*df.columns}
        return made[label]

    monkeypatch.setattr(common, "written", written)
    assert sum(len(r["dropped"]) for r in line_dedup.dropped_lines(docs(spark, texts)).collect()) > 0 and "line-pairs" in made


def test_line_dedup_proves_links_by_parts_only_where_the_distance_does(spark):
    rng = random.Random(27)
    rows = []
    for k in range(300):
        x = "".join(rng.choice("abcdef") if k % 3 else rng.choice("ab") for _ in range(rng.randint(1, 240)))
        y = list(x)
        for _ in range(rng.randint(0, 1 + len(x) // 4)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "z", "ab", x[:9]])
        rows.append((x, "".join(y), distance(x, "".join(y))))
    got = spark.createDataFrame(rows, "x string, y string, d int").selectExpr("*", "cast(floor(greatest(length(x), length(y)) * 0.15D + 1e-9D) as int) as most")
    got = got.selectExpr("d", "most", line_dedup._let("s", "named_struct('x', x, 'y', y)", line_dedup._by_parts("s")) + " as proved").collect()
    assert all(r["d"] <= r["most"] for r in got if r["proved"]) and sum(r["proved"] for r in got) > 20


def test_line_dedup_bands_keep_alike_lengths_together(spark):
    sizes = sorted({*range(1, 60), *range(1700, 2500), *range(2600, 9000, 37)})
    rows = spark.createDataFrame([(n,) for n in sizes], "l int").selectExpr("l", f"{line_dedup._band('l')} as band")
    two = rows.alias("x").join(rows.alias("y"), F.expr(f"x.l <= y.l and {line_dedup._alike('x.l', 'y.l')}"))
    assert two.where("y.band - x.band not in (0, 1)").isEmpty() and two.where("y.band = x.band + 1").count() > 1000


def test_line_dedup_compares_very_long_lines_by_words(spark):
    rng = random.Random(19)
    words = [f"word{rng.randrange(5000)}" for _ in range(1500)]
    near = list(words)
    for k in range(0, 1500, 40):
        near[k] = f"other{k}"
    texts = [" ".join(words), " ".join(near), " ".join(rng.sample(words, 1500))]
    assert {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(docs(spark, texts)).collect()} == {0: [], 1: [0], 2: []}


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(16, 60))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(4)) + ".") for i in range(60)] + [(90, None), (91, "")]
    texts, want = list(ODD), {}
    for k in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if k % 2:
            item = rng.choice(items[:60])
            w.insert(rng.randint(0, len(w)), item[1].upper() if k % 4 == 1 else item[1])
            want[len(texts)] = [item[0]]
        texts.append(" ".join(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.hits(docs(spark, texts), bench).collect():
        got.setdefault(r["doc_id"], []).append(r["item_id"])
    assert got == want
    kept = decontaminate.clean(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if i not in want]
    assert decontaminate.hits(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_looks_behind_a_decoy(spark):
    rng = random.Random(12)
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    items, texts = [], []
    for k in range(20):
        question, answer = words(f"q{k}x", 40 + k % 8), words(f"a{k}x", 8)
        items.append((k, " ".join(question) + ". " + " ".join(answer) + "."))
        decoy = question + rng.sample(answer, 8)  # every word of the item inside one passage, its answer in another order
        apart = words(f"f{k}x", 384 - len(decoy) + 16 + k % 8)  # the item then lies across the borders of passages
        texts += [" ".join(decoy + apart + question + answer), " ".join(decoy + apart), " ".join(apart + question + answer + apart + decoy)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i // 3) for i in range(len(texts)) if i % 3 != 1}
    found = decontaminate.hits(docs(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    assert all(r["first_word"] >= 350 for r in found)
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), bench).collect()} == {i for i in range(len(texts)) if i % 3 == 1}


def test_html_names_of_the_layout_drop_no_article():
    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    article = f"<h1>{say(1, 5)}</h1><p>{say(2)}</p><p>{say(3)}</p>"
    want = "\n".join((say(1, 5), say(2), say(3)))
    menu, comments = f"<nav><ul><li><a href=x>{say(8, 2)}</a></li></ul></nav>", f'<div id="comments"><p>{say(9, 30)}</p></div>'
    for layout in ("no-sidebar", "has-comments", "search-open", "legal", "overflow-hidden"):
        assert html_text.extract(f'<html><body class="{layout}">{menu}<article>{article}</article>{comments}</body></html>') == want
        assert html_text.extract(f'<body>{menu}<article class="post {layout}">{article}</article>{comments}</body>') == want
    for layout in ("no-sidebar", "has-comments", "search-open"):
        assert html_text.extract(f'<body><div class="{layout}">{menu}<article>{article}</article>{comments}</div></body>') == want
    for name in ("search", "discussion", "legal", "feedback", "notice"):
        section = f'<section id="{name}"><h2>{say(4, 3)}</h2><p>{say(5)}</p></section>'
        assert html_text.extract(f"<body>{menu}<article>{article}{section}</article>{comments}</body>") == "\n".join((want, say(4, 3), say(5)))
    within = article.replace("w2x9", "w2x9 <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> <object data=x>held</object>")
    assert html_text.extract(f"<body>{menu}<article>{within}</article></body>") == want.replace("w2x9", "w2x9 x=2 held")
    # More comments than article: still left out, also inside it.
    many = f'<section class="comments">{"".join(f"<article class=comment><p>{say(k)}</p></article>" for k in range(20, 30))}</section>'
    assert html_text.extract(f"<body>{menu}<article>{article}</article>{many}</body>") == want == html_text.extract(f"<body>{menu}<article>{article}{many}</article></body>")


def test_block_max_wand_is_exact():
    rng = random.Random(10)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 80}" for _ in range(30))) for i in range(150)]
    frequency = {}
    for _, t in items:
        for w in set(t.split()):
            frequency[w] = frequency.get(w, 0) + 1
    index = decontaminate.build_index(items, frequency, len(items), 30.0)
    for _ in range(60):
        query = set(rng.sample(range(len(index.terms)), min(12, len(index.terms))))
        scores = {}
        for t in query:
            for item, gain in zip(*index.postings[t], strict=True):
                scores[item] = scores.get(item, 0) + gain
        for threshold in (0.1, 0.3, 0.6):
            got = dict(index.retrieve(query, threshold))
            assert {k for k, v in scores.items() if v >= threshold + 1e-6} <= set(got) <= {k for k, v in scores.items() if v >= threshold - 1e-6}


def test_media(spark):
    rng = np.random.default_rng(11)
    t = np.arange(media.HOP * 2) / media.RATE
    song = lambda n: np.concatenate([sum(0.1 * np.sin(2 * np.pi * 220 * 2 ** ((k + 12 * o) / 12) * t) for o, k in enumerate(rng.integers(0, 12, 3))) for _ in range(n)])
    songs = [song(30) for _ in range(4)]
    rows = [(i, media.encode_wav(s)) for i, s in enumerate(songs)]
    rows += [(10, rows[0][1]), (11, media.encode_wav(songs[1] + rng.normal(0, 0.01, len(songs[1])))), (12, media.encode_wav(songs[2][media.HOP * 12 + 100 :])), (13, None), (14, b""), (15, b"no audio"), (16, media.encode_wav(np.zeros(9000)))]
    got = {r["id"]: r for r in media.align_recordings(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    assert {i: got[i]["group_id"] for i in got} == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 1, 12: 2, 13: 13, 14: 14, 15: 15, 16: 16}
    assert got[10]["class_id"] == 0 and got[13]["n_frames"] == 0
    a = media.fingerprint(media.chroma(*media.decode_wav(rows[2][1])))
    offset, error, n = media.align(a, media.fingerprint(media.chroma(*media.decode_wav(dict(rows)[12]))))
    assert offset == 12 and error < media.ERROR and n > 30


def test_media_every_place_votes():
    rng = np.random.default_rng(15)
    for k in range(30):
        b = rng.integers(0, 4 if k % 2 else 1 << 20, int(rng.integers(300, 900)), dtype=np.uint32)
        b[: int(rng.integers(0, 300))] = 7  # a held tone
        a = b[int(rng.integers(0, 250)) :][: int(rng.integers(1, 200))].copy()
        a[rng.random(len(a)) < 0.1] ^= np.uint32(1)
        for x, y in ((a, b), (b, a)):
            votes = {}
            for i, j in np.argwhere(x[:, None] == y[None, :]).tolist():
                votes[i - j] = votes.get(i - j, 0) + 1
            if votes:
                assert media.align(x, y)[0] == min(votes, key=lambda o: (-votes[o], o))
    loop = np.concatenate([np.full(300, 7), rng.integers(0, 1 << 20, 20), np.full(100, 7), rng.integers(0, 1 << 20, 3)]).astype(np.uint32)
    part = loop[290:]
    assert media.align(part, loop) == (-290, 0.0, len(part)) and media.align(loop, part) == (290, 0.0, len(part))


def test_media_short_recordings(spark):
    rng = np.random.default_rng(14)
    t = np.arange(media.HOP) / media.RATE
    song = lambda n: np.concatenate([sum(0.3 * np.sin(2 * np.pi * 220 * 2 ** ((k + 12 * o) / 12) * t) for o, k in enumerate(rng.integers(0, 12, 3))) for _ in range(n)])
    short = [song(n) for n in (1, 2, 4, 6, 7, 9)]
    rows = [(i, media.encode_wav(s)) for i, s in enumerate(short)]
    rows += [(10 + i, v) for i, v in rows[:6]]
    rows += [(20 + i, media.encode_wav(0.9 * s)) for i, s in enumerate(short)]
    rows += [(30, media.encode_wav(np.zeros(media.FRAME))), (31, media.encode_wav(np.zeros(media.FRAME + media.HOP)))]
    got = {r["id"]: r for r in media.align_recordings(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    assert all(r["n_ints"] == max(r["n_frames"] - media.WIDTH + 1, 1) for r in got.values())
    assert all(got[10 + i]["class_id"] == i and got[20 + i]["group_id"] == got[10 + i]["group_id"] == i for i in range(6))
    assert [got[i]["group_id"] for i in (30, 31)] == [30, 31]


def test_media_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(13)
    prints = []
    for _ in range(4):
        base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        for _ in range(14):  # few integers stay whole, and other ones in each variant
            cut = int(rng.integers(0, 40))
            v = base[cut : cut + int(rng.integers(3, 40))].copy()
            for i in np.flatnonzero(rng.random(len(v)) < 0.7):
                v[i] ^= np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, int(rng.integers(1, 4))).astype(np.uint32))
            prints.append(v)
    rows = [(i, len(v) + media.WIDTH - 1, len(v), 1000 - i, v.view(np.int32).tolist()) for i, v in enumerate(prints)]
    got = {r["id"]: r for r in media.align_prints(spark.createDataFrame(rows, media._PRINTS)).collect()}
    label, links = list(range(len(prints))), []
    for a in label:
        for b in range(a + 1, len(prints)):
            _, error, n = media.align(prints[a], prints[b])
            if error <= media.ERROR and n >= min(media.MIN_FRAMES, len(prints[a]), len(prints[b])):
                links.append((a, b))
    for _ in prints:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    kept = sum(got[a]["group_id"] == got[b]["group_id"] for a, b in links)
    assert len(links) > 50 and kept >= 0.9 * len(links)
    assert all(label[a] == label[got[a]["group_id"]] for a in got)  # nothing is linked that should not be


def linked(prints, side=None):
    """Components of an aligner of all pairs that share a sound (of different sides)."""
    label = list(range(len(prints)))
    links = []
    for a in label:
        for b in range(a + 1, len(prints)):
            if (side is None or side[a] != side[b]) and (np.intersect1d(prints[a], prints[b]) != media.SILENCE).any():
                _, error, n = media.align(prints[a], prints[b])
                if error <= media.ERROR and n >= min(media.MIN_FRAMES, len(prints[a]), len(prints[b])):
                    links.append((a, b))
    return components_of(len(prints), links)


def components_of(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_media_one_common_integer_is_enough(spark):
    rng = np.random.default_rng(21)
    prints = []
    for _ in range(12):
        base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        other = base ^ (np.uint32(1) << rng.integers(0, 32, 60).astype(np.uint32))
        at = int(rng.integers(0, 60))
        other[at] = base[at]
        prints += [base, other]
    rows = [(i, len(v) + media.WIDTH - 1, len(v), 1000 - i, v.view(np.int32).tolist()) for i, v in enumerate(prints)]
    got = {r["id"]: r["group_id"] for r in media.align_prints(spark.createDataFrame(rows, media._PRINTS)).collect()}
    assert [got[i] for i in range(24)] == linked(prints) == [i // 2 * 2 for i in range(24)]


def test_media_cells_find_every_link():
    rng = np.random.default_rng(22)
    for trial in range(4):
        prints = []
        for _ in range(4):
            base = rng.integers(0, 1 << 32, 80, dtype=np.uint32)
            if trial == 1:
                base[10:] = rng.integers(0, 3, 70)  # few different integers
            if trial == 2:
                base = np.concatenate([base, np.full(150, media.SILENCE)])
            for _ in range(10):
                cut = int(rng.integers(0, 40))
                v = base[cut : cut + int(rng.integers(1, len(base)))].copy()
                for i in np.flatnonzero(rng.random(len(v)) < 0.85):
                    v[i] ^= np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, int(rng.integers(1, 6))).astype(np.uint32))
                prints.append(v)
        one, two = np.zeros(len(prints), int), rng.integers(0, 2, len(prints))
        assert components_of(len(prints), media.cell_links(prints, one)) == linked(prints)
        got = media.cell_links(prints, two)
        assert all(two[a] != two[b] for a, b in got) and components_of(len(prints), got) == linked(prints, two)


def test_media_compares_two_places_once(monkeypatch):
    rng = np.random.default_rng(26)
    prints = [rng.integers(0, 1 << 32, 40, dtype=np.uint32) for _ in range(20)]
    for a in range(0, 20, 2):  # one integer by chance, in two that do not align
        prints[a + 1][7] = prints[a][20]
    compared, close = [], media._close
    monkeypatch.setattr(media, "_close", lambda *args: compared.append(len(args[-1])) or close(*args))
    for side in (np.arange(20) % 2, np.zeros(20, int)):
        compared.clear()
        assert media.cell_links(prints, side) == [] and sum(compared) == 10


def test_media_sums_are_those_of_whole_overlaps():
    rng = np.random.default_rng(27)
    ints = rng.integers(0, 1 << 32, 600, dtype=np.uint32)
    ints[300:] = ints[:300] ^ (np.uint32(1) << rng.integers(0, 32, 300).astype(np.uint32)) ^ np.where(rng.random(300) < 0.27, rng.integers(0, 1 << 32, 300), 0).astype(np.uint32)
    x, m = rng.integers(0, 200, 3000), rng.integers(1, 100, 3000)
    want = [np.bitwise_count(ints[a : a + k] ^ ints[300 + a : 300 + a + k]).sum() <= media.ERROR * 32 * k + 1e-6 for a, k in zip(x, m, strict=True)]
    assert media._close(media._rows(ints), x, x + 300, m).tolist() == want and 300 < sum(want) < 2700


def test_media_groups_do_not_depend_on_cells(spark, monkeypatch):
    rng = np.random.default_rng(23)
    base = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    prints = [base[i : i + 40] for i in range(0, 260, 20)] + [rng.integers(0, 1 << 32, 30, dtype=np.uint32) for _ in range(9)]
    rows = [(i, len(v) + media.WIDTH - 1, len(v), 1000 - i, v.view(np.int32).tolist()) for i, v in enumerate(prints)]
    for cell in (media.CELL, 200):
        monkeypatch.setattr(media, "CELL", cell)
        got = {r["id"]: r["group_id"] for r in media.align_prints(spark.createDataFrame(rows, media._PRINTS)).collect()}
        assert [got[i] for i in range(len(prints))] == [0] * 13 + list(range(13, 22))


def test_media_equal_frames_give_equal_integers_anywhere():
    rng = np.random.default_rng(16)
    table = media.chord_frames()
    songs = [table[rng.integers(0, 1728, int(n))] for n in rng.integers(0, 40, 60)] + [np.zeros((9, 12), np.float32)]
    together = media.fingerprints_of(songs)
    assert all(np.array_equal(x, media.fingerprint(s)) for x, s in zip(together, songs, strict=True))
    assert (together[-1] == media.SILENCE).all() and len(media.around(together[-1])) == len(together[-1])


def test_media_of_turns_holds_nulls_and_copies(spark):
    rows = [(1, 0, None), (1, 1, ""), (1, 2, "one two three four five six seven eight nine ten"), (2, 0, "one two three four five six seven eight nine ten"), (None, 3, "one two"), (3, 0, "a")]
    made = media.align_prints(media.played(spark.createDataFrame(rows, "conv_id long, turn long, text string")))
    got = {r["id"]: r for r in made.collect()}
    first = (1 << 20) + 2
    assert len(got) == 6 and got[2 << 20]["class_id"] == got[2 << 20]["group_id"] == first and got[1 << 20]["n_frames"] == 0 and got[None]["group_id"] is None


def test_empty_tables(spark):
    none = docs(spark, ["a"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_join.jaccard_components(none).count() == 0 and line_dedup.dropped_lines(none).count() == 0
    assert token_count.count_tokens(none).count() == 0 and quality.keep_good(none, labels).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert media.align_recordings(spark.createDataFrame([], "id long, audio binary")).count() == 0
    assert html_text.main_texts(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first()["text"] == ""


def test_pipeline_stages(spark):
    import os

    import corpus_pipeline

    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    start = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = start
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.written(stage(spark, rows, DATA), "test-stage")
        assert rows.columns == start.columns
    out = corpus_pipeline.STAGES[-1][1](spark, rows, DATA)
    assert out.count() == rows.count() and out.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def test_slices_are_bounded_by_bytes_and_lose_nothing():
    texts = ["a" * (common.SLICE_BYTES * 2) if i in (3, 4, 700) else None if i == 9 else "x" * 3000 for i in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(texts)], ["doc_id", "text"])
    parts = list(common.rows_of(batch))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1300))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert max(p.num_rows for p in parts) <= 512 and all(sum(len(x or "") for x in p.column(1).to_pylist()) <= 3 * common.SLICE_BYTES for p in parts)
    assert list(common.rows_of(batch.slice(0, 0))) == []
