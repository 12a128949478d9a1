"""Each operator on small tables with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmark.llm import decontaminate, htmltext, linededup, minhash, mixing, substrings, surrogates, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, doc int, row int, block int, size int"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % k for k in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 120)
    near = " ".join([*base.split()[:118], "other", "end"])
    shared = "This very line stands in many documents and has forty characters.\n"
    texts = [None, "", "one two", base, near, base.upper(), words(2, 30) + " " + " ".join(base.split()[10:60]), words(3, 30000)] + [shared + words(10 + k, 8) for k in range(6)]
    rows = [(k, t, "en", ["b", "a", None][k % 3], len(t or ""), 1, "x", 1, 1, 1, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "en", "a", 5, 1, "x", 1, 1, 1, 1)], DOCS)


def test_decontamination_matches_brute_force(spark, docs):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    some = docs.where("doc_id = 3").first().text.split()
    bench = [(7, " ".join(some[5:17]).upper()), (8, "one, TWO"), (9, None), (10, "nowhere at all"), (7, "one two")]
    bench_df = spark.createDataFrame(bench, "item_id long, text string")
    windows = {}
    for item, t in bench:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    for block in (10**6, 8):
        got = decontaminate.digest(decontaminate.find_matches(docs, bench_df, block_words=block)).collect()
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        for r, (_, t) in zip(sorted(got, key=lambda r: str((r.doc_id, ""))), sorted(texts, key=lambda x: str((x[0], ""))), strict=True):
            w, hit, items = split(t), set(), set()
            for win, owners in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        items |= owners
            want = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), want, bool(hit))
    assert decontaminate.remove_contaminated(docs, bench_df).columns == docs.columns
    assert decontaminate.remove_contaminated(docs, bench_df.limit(0)).count() == docs.count()


def test_minhash_links_copies_only(docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 85).collect()}
    assert [got[k].component_id for k in (0, 1, 2, 3, 4, 5, 6, 7)] == [0, 1, 2, 3, 3, 3, 6, 7]
    assert got[0].n_shingles == 0 and got[2].n_shingles == 1 and got[None].component_id is None
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns and {4, 5}.isdisjoint(r.doc_id for r in kept.collect())


def test_minhash_large_group_of_near_copies(spark):
    base = words(5, 200).split()
    rows = []
    for k in range(300):
        w = list(base)
        w[(k * 7) % 200] = f"changed{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, 85).collect()} == {0}


def test_line_dedup(docs):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert [got[k].n_dropped for k in range(8, 14)] == [1, 1, 1, 1, 1, 0]
    assert got[0].text == "" and got[0].n_lines == 1 and "\n" not in got[8].text and got[13].text.startswith("This very line")
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_substrings_match_brute_force(spark, docs):
    rows = docs.where("doc_id IS NOT NULL AND doc_id < 8").dropDuplicates(["doc_id"])
    extra = words(40, 25)
    rows = rows.select("doc_id", "text").unionByName(spark.createDataFrame([(50, extra + " " + extra), (51, extra)], "doc_id long, text string"))
    seen, want = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        w = (r.text or "").split()
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        want[r.doc_id] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.find_repeats(rows).collect()}
    assert got == want and want[50][1] == 25 and want[51][1] == 25
    assert substrings.find_repeats(docs).count() == docs.count()


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[30:40] = x[0] + rng.normal(size=(10, 8)) * 0.05
    x[40] = x[1] * 3
    rows = [(k, [float(c) for c in v], 1) for k, v in enumerate(x)] + [(60, None, 1), (61, [0.0] * 8, 1), (62, [float("nan")] * 8, 1), (63, [1.0, 2.0], 1), (64, [float(c) for c in x[0]], 1), (65, [], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    y = np.vstack([x, x[:1]])
    ids = [*range(60), 64]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = y @ y.T >= 0.9
    np.fill_diagonal(hit, False)
    for k, i in enumerate(ids):
        assert got[i].n_links == hit[k].sum()
    assert got[64].component_id == 0 and got[40].component_id == 1 and all(got[i].n_links == 0 and got[i].component_id == i for i in (60, 61, 62, 63, 65))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_toxicity_learns_and_catches_misspellings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        w = words(100 + k, 40).split()
        bad = k % 4 == 0
        if bad:
            w[int(rng.integers(0, 40))] = "worthless"
            w[int(rng.integers(0, 40))] = "grumble" if k % 8 else "worthless"
        rows.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    got = {r.doc_id: r.score for r in toxicity.score(df.unionByName(spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "a worthles thing", 0)], df.schema)), model).collect()}
    held = [k for k in range(600) if got[k] is not None]
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert got[900] == got[901] < 0.5 and 0 <= got[902] <= 1
    import pyarrow as pa

    from glyphmark.llm.textcore import ALNUM, chunks

    for c in chunks(pa.array(["worthles wortless worthless worth less"]), True, ALNUM):
        word, _, edits = model.lexicon.hits(c)
        assert word.tolist() == [0, 1, 2] and edits.tolist() == [1, 1, 0]
    assert toxicity.train(df.limit(0), df.limit(0)).score(pa.array(["x"]))[0] < 0.5


def test_mixing(docs):
    got = mixing.mixed_counts(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.mixed_counts(docs.repartition(3)).collect())
    targets = mixing.source_targets([("b", 10), ("a", 100), (None, 1000)])
    assert [t[0] for t in targets] == ["a", "b", None] and sum(t[2] for t in targets) == pytest.approx(1110) and all(t[2] <= 3 * t[1] for t in targets)
    assert mixing.mixed_counts(docs.limit(0)).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "mix_copies"]


PAGE = "<html><head><title>T</title><script>if(a<b)('<p>no</p>')</script></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu one</ul></nav><div class='cookie-notice'>We use cookies on this site</div>{}<aside>Side words here</aside><section class=comments><p>First comment said so</p></section><form><label>Name</label></form><footer>Foot &copy;</footer></body></html>"
BODY = "<h1>Head &amp; line</h1><p>First  <b>bold</b>text\n here.<div class=ad>Buy now please</div><p>Second &#233;&nbsp;one<!-- note --></p>"


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div class='post'>{}</div>", "<main>{}</main>"])
def test_html_regions(outer):
    w = htmltext.Weights({}, {})
    assert htmltext.extract(PAGE.replace("{}", outer.replace("{}", BODY)), w) == "Head & line\nFirst boldtext here.\nSecond é one"
    assert htmltext.extract(None, w) == htmltext.extract("", w) == htmltext.extract("<p", w) == ""


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE.replace("{}", "<article>" + BODY + "</article>"), 5), (2, None, None, 5), (2, None, None, 5)], "page_id long, url string, html string, text int")
    got = htmltext.extract_pages(df, htmltext.train(df)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 45]
    assert htmltext.extract_pages(df.limit(0), htmltext.train(df.limit(0))).count() == 0


def test_surrogates(spark):
    t = "Call +1 (743) 555-3824 or hein.19@mail5.example.com, Mrs. Anna Schmidt and Mr. Schmidt at 196.197.208.3, card 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, t, "a"), (2, "again hein.19@mail5.example.com", "b"), (3, None, "c"), (4, "plain text 2024", "d"), (4, "plain text 2024", "d")], "doc_id long, text string, entities string")
    got = {r.doc_id: r for r in surrogates.pseudonymize(df, "k").collect()}
    new = got[1].text
    for value in ("555-3824", "hein.19", "mail5", "Anna", "Schmidt", "196.197.208.3", "4111 1111 1111 1111"):
        assert value not in new
    assert new.startswith("Call +1 (") and got[1].n_entities == 6 and got[3].text is None and got[4].text == "plain text 2024"
    e = next(x for x in got[1].entities if x.kind == "email")
    assert got[2].text == "again " + new[e.start : e.start + e.n_chars]
    family = re.search(r"Mrs\. \S+ (\S+) and Mr\. (\S+) at", new)
    assert family[1] == family[2]
    few = surrogates.pseudonymize(df, "k", max_broadcast=-1)
    assert sorted(str(r.text) for r in few.collect()) == sorted(str(r.text) for r in surrogates.pseudonymize(df, "k").collect())


def test_surrogates_stay_distinct(spark):
    rows = [(k, f"Mr. Name{k}x") for k in range(3000)]
    df = spark.createDataFrame([(k, t.replace(str(k), "".join(chr(97 + int(c)) for c in str(k)))) for k, t in rows], "doc_id long, text string")
    assert len({r.text for r in surrogates.pseudonymize(df, "k").collect()}) == 3000


def test_surrogates_stay_distinct_where_their_format_is_used_up(spark, monkeypatch):
    phones = [f"+1 {k // 100:02d} {k % 100:02d}" for k in range(5100)]
    df = spark.createDataFrame(list(enumerate(phones)), "doc_id long, text string")
    new = {r.text for r in surrogates.pseudonymize(df, "k").collect()}
    assert len(new) == 5100 and not new & set(phones)
    monkeypatch.setattr(surrogates, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="still collide"):
        surrogates.pseudonymize(df, "k")


def test_surrogates_of_every_script():
    assert surrogates.surrogate("email", "佐藤@例え.jp", "k") != "佐藤@例え.jp"
    for word in ("佐藤", "παῦλος", "şahin", "łódź", "יוסף", "김철수", "ёлка", "სახლი"):
        new = surrogates.surrogate("email", f"{word}@example.jp", "k")
        local = new.split("@")[0]
        assert len(local) == len(word) and local != word and local.isalpha()
    growing = [surrogates.surrogate("family", "Schmidt", "k", n) for n in (0, 2, 8, 20)]
    assert len(growing[0]) <= 8 < len(growing[2]) < len(growing[3])


def test_pipeline_runs_on_its_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() and "mix_copies" in out.columns and len(corpus_pipeline.STAGES) == 5
    assert out.where(F.col("mix_copies") > 3).count() == 0
