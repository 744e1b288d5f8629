"""The operators as Spark jobs: brute force, nulls, ties, repeated rows, empty tables, clashing names, long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway import session
from sluiceway.llm import blocks, boilerplate, languages, leaks, mixing, quality, repeats, review, support, templates
from sluiceway.llm import pages as P

PAGE = "page_id bigint, url string, title string, content string"
FRAME = "page_id bigint, frame_no int, char_count bigint, link_char_count bigint"
PROSE = "The old bridge of the town is closed, and nobody has said why it was so for a year."


def page_rows():
    spam = " | ".join(["cheap red lamp", "red lamp", "best red lamp"] * 12)
    items = "\n".join(f"- item N{i}" for i in range(12))
    links = "\n".join(f"N{i} bridge" for i in range(20))
    article = "\n".join(["Home | About", "The headline of it", PROSE, "and so it was", PROSE, "A subhead", PROSE, "Other page one", "Other page two", "© 2020 X. All rights reserved"])
    rows = [
        (1, "http://a.test/1", "Spam", spam), (2, "http://a.test/2", "List", items), (3, "http://a.test/3", "Links", links), (4, "http://a.test/4", "The headline of it", article), (5, "http://a.test/5", "Error", "404 Not found"),
        (6, "http://a.test/6", None, None), (7, None, "", "   \n "), (8, "http://a.test/8", None, PROSE), (1, "http://a.test/1", "Spam", spam), (None, None, None, None), (9, "http://a.test/9", "{{title}}", PROSE),
    ]
    frames = [(3, 0, len("".join(links.split("\n"))), len("".join(links.split("\n"))) - 3), (4, 0, len("Home | About"), 9), (4, 0, len("Home | About"), 9), (4, 9, None, None), (77, 0, 5, 5)]
    return rows, frames


def test_page_operators(spark):
    rows, frames = page_rows()
    pages = spark.createDataFrame(rows, PAGE).withColumn("site", F.lit("clash")).withColumn("kinds", F.lit(1))
    frames_ = spark.createDataFrame(frames, FRAME)
    ids = lambda df: sorted(r[0] for r in df.collect())
    r = review.Review(pages, frames_)
    assert ids(r.list_pages()) == [1, 2, 3] and ids(r.residue()) == [5, 9] and ids(r.keyword_pages()) == [1, 3]
    assert ids(review.Review(pages).residue()) == [5, 9] and review.Review(pages).residue_origins().exceptAll(r.residue_origins()).count() == 0
    got = {tuple(x) for x in r.boilerplate_lines().collect()}
    assert got == {(4, 1), (4, 8), (4, 9), (4, 10)}
    assert {tuple(x) for x in r.lines().collect() if x[0] == 4} == got
    body = {x["page_id"]: x["body"] for x in boilerplate.main_body(pages.filter("page_id = 4").select("page_id", "content"), r.boilerplate_lines()).collect()}
    assert body[4].split("\n") == ["The headline of it", PROSE, "and so it was", PROSE, "A subhead", PROSE]


def test_page_operators_on_no_rows(spark):
    pages, frames = spark.createDataFrame([], PAGE), spark.createDataFrame([], FRAME)
    r = review.Review(pages, frames)
    for df in (r.list_pages(), r.residue(), r.keyword_pages(), r.boilerplate_lines(), repeats.repeated_lines(pages), quality.counts(pages, "page_id", F.col("content"))):
        assert df.count() == 0


def corpus(seed, n_sites=8, per_site=12):
    """Articles in words of their own between a site's furniture, error pages and filled and unfilled letters; and the furniture's places."""
    rng = random.Random(seed)
    nouns = [f"{a}{b}" for a in "brick canal flint grove hazel ivory jetty kiln ledge marsh".split() for b in ("", "way", "field", "man", "stone", "house")]
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was {rng.choice(['lost', 'sold', 'seen', 'kept'])} by {rng.randint(2, 99)} of them, and so it is that the {rng.choice(nouns)} has a {rng.choice(nouns)}."
    names = ["Ada Brook", "Ben Cole", "Cy Dunn", "Eve Frost", "Gus Hale"]
    rows, frames, furniture, i = [], [], set(), 0
    for s in range(n_sites):
        host = f"site{'abcdefghijklmnop'[s]}x.test"
        top = ["Start · Wares · Crew", "We and our helpers keep notes on your device to make ads fit you.", "Skip to the text"]
        end = ["Our writers may earn a fee when you buy through links here.", "Do not sell my data", f"Reprint only with leave of {host.split('.')[0].title()}."]
        for p in range(per_site):
            by = f"Put down by {rng.choice(names)} in {rng.randint(1990, 2020)}"
            body = [" ".join(sentence() for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(3, 6))]
            tail = [f"The {rng.choice(nouns)} in {rng.choice(nouns)}" for _ in range(3)]
            lines = [*top, by, *body, *tail, *end]
            rows.append((i, f"http://{host}/{p}", f"On the {rng.choice(nouns)} {i}", "\n".join(lines)))
            furniture |= {(i, n) for n in (1, 2, 3, 4)} | {(i, n) for n in range(5 + len(body), len(lines) + 1)}
            frames += [(i, k, len(x.encode()), len(x) if x in tail or k in (0, 2) else 0) for k, x in enumerate(lines)]
            i += 1
    return rows, frames, furniture


def test_boilerplate_is_found_without_any_list_of_phrases(spark):
    rows, frames, furniture = corpus(1)
    r = review.Review(spark.createDataFrame(rows + rows[:9], PAGE), spark.createDataFrame(frames, FRAME))
    got = {tuple(x) for x in r.boilerplate_lines().collect()}
    assert len(got & furniture) >= 0.95 * len(got) and len(got & furniture) >= 0.95 * len(furniture)
    assert r.list_pages().count() == 0 and r.residue().count() == 0


def test_body_lines_that_crawls_and_sites_repeat_stay(spark):
    """Crawls of one url count once, and a sentence of several sites that no site repeats is body."""
    rows, frames, _ = corpus(2, 4)
    again = [(1000 + k, *rows[0][1:]) for k in range(8)]
    quote = "It was the best of bridges, and it was the worst of bridges for all of the town."
    rows = [(i, u, t, f"{x}\n{quote}\n{PROSE}" if i % 12 == 5 else x) for i, u, t, x in rows]
    got = {tuple(x) for x in review.Review(spark.createDataFrame(rows + again, PAGE), spark.createDataFrame(frames, FRAME)).boilerplate_lines().collect()}
    by = {i: x.split("\n") for i, _, _, x in rows + again}
    assert not any(by[i][n - 1] == quote or by[i][n - 1].startswith("The ") and by[i][n - 1].endswith(".") for i, n in got)


def test_whole_error_templates_of_any_length_and_wording(spark):
    rows, frames, _ = corpus(3, 6)
    short = "Wir ruhen uns aus bis Montag"
    long = "\n".join(f"Nothing stands at this door, which was shut for good on day {k}. Knock at the other one, as those before you have." + f" Reason {chr(97 + k)}{chr(98 + k)} of the keeper." for k in range(14))
    errors = [(2000 + k, f"http://{'abcdef'[k % 6]}-e.test/{k}", f"The lost {'brick canal flint grove hazel ivory'.split()[k % 6]}", [short, long][k // 6]) for k in range(12)]
    copies = [(3000 + k, f"http://{'abcdef'[k]}-c.test/", "On the old bridge", PROSE + " It was a long and cold year for all of them.") for k in range(6)]  # one article on many sites
    got = {r[0] for r in review.Review(spark.createDataFrame(rows + errors + copies, PAGE)).residue().collect()}
    assert got == {r[0] for r in errors}


def test_slots_that_others_fill(spark):
    rows, _, _ = corpus(4, 3)
    filled = [(2000 + k, f"http://a.test/{k}", f"Letter {k}", f"{PROSE}\nDear {n}, we wrote to you.\n{PROSE}") for k, n in enumerate(["Anna", "Bob", "Carl"])]
    open_ = [(2100, "http://a.test/9", "Letter", f"{PROSE}\nDear , we wrote to you.\n{PROSE}"), (2101, "http://b.test/9", "Letter", f"{PROSE}\nDear null, we wrote to you.\n{PROSE}")]
    alone = [(2102, "http://b.test/8", "Note", f"{PROSE}\nHe put null , we heard.\n{PROSE}")]
    got = {r["page_id"]: r["origin"] for r in review.Review(spark.createDataFrame(rows + filled + open_, PAGE)).residue_origins().collect()}
    assert got == {2100: templates.BY_SLOT, 2101: templates.BY_SLOT}
    assert review.Review(spark.createDataFrame(rows + open_[:1], PAGE)).residue().count() == 0  # no record fills it
    assert review.Review(spark.createDataFrame(rows + alone, PAGE)).residue().count() <= 1


@pytest.mark.parametrize("n", [0, 2, 20])
def test_slots_that_others_fill_in_lines_of_any_length(spark, n):
    rows, _, _ = corpus(6, 3)
    line = lambda name: f"{PROSE} " * n + f"Dear {name}, we wrote to you."
    filled = [(2000 + k, f"http://a.test/{k}", f"Letter {k}", f"{PROSE}\n{line(x)}\n{PROSE}") for k, x in enumerate(["Anna", "Bob", "Carl"])]
    open_ = [(2100, "http://a.test/9", "Letter", f"{PROSE}\n{line('')}\n{PROSE}"), (2101, "http://b.test/9", "Letter", f"{PROSE}\n{line('null')}\n{PROSE}")]
    beside = [(2102, "http://b.test/8", "Note", f"{PROSE}\n{line('Eve')} He put null on the old form.\n{PROSE}")]  # its own slot is filled
    got = {r["page_id"]: r["origin"] for r in review.Review(spark.createDataFrame(rows + filled + open_ + beside, PAGE)).residue_origins().collect()}
    assert got == {2100: templates.BY_SLOT, 2101: templates.BY_SLOT}


def test_counts_of_keys_are_shuffled_once_for_all_who_read_them_alike(spark):
    rows, _, _ = corpus(1, 4, 6)
    facts = session.cut(quality.read_pages(spark.createDataFrame(rows, PAGE), review._light_facts, f"site bigint, u bigint, {P.PAGE}"))
    hits = support.key_classes(facts)
    assert hits.count() and hits.collect()
    assert "ReusedExchange" in hits._jdf.queryExecution().executedPlan().toString()


def test_counts_of_keys_are_shuffled_once_and_hits_are_moved_as_rows(spark):
    rows, _, _ = corpus(1, 4, 6)
    facts = session.cut(quality.read_pages(spark.createDataFrame(rows + rows[:5], PAGE), review._light_facts, f"site bigint, u bigint, {P.PAGE}"))
    hits = support.key_classes(facts)
    got = [[(h["line"], h["key"]) for h in r["hits"]] for r in hits.collect()]
    assert got and all(len(x) == len(set(x)) for x in got)  # once each, copies of a page included
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2 and "partial_collect_set" not in plan


def test_residue_keeps_no_columns_that_only_others_ask(spark):
    rows, _, _ = corpus(1, 3, 4)
    kept = []
    real = session.cut
    try:
        review.cut = lambda df: kept.append(df.columns) or real(df)
        light = {r[0] for r in review.Review(spark.createDataFrame(rows, PAGE)).residue().collect()}
        frames = spark.createDataFrame([], "page_id bigint, frame_no int, char_count int, link_char_count int")
        assert light == {r[0] for r in review.Review(spark.createDataFrame(rows, PAGE), frames).residue().collect()}
    finally:
        review.cut = real
    assert not set(P.FULL) & set(kept[0]) and set(P.FULL) <= set(kept[2])


@pytest.mark.parametrize("chunk", [7, 700, 1 << 17])
def test_statistics_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice([PROSE, "- item", "", "a  1  2", "x" * 70, "Home | About", "word " * 500, " " * 900 + "1 | 2 | 3" + " " * 900]) for _ in range(rng.randrange(30))) for _ in range(12)] + [None, ""]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "id bigint, t string")
    got = {r["page_id"]: list(r["v"]) for r in quality.counts(df, "id", F.col("t"), chunk).collect()}
    assert got == {i: P.counts(P.read(t or "")[0]) for i, t in enumerate(texts)}
    stats = {r["page_id"]: r for r in quality.ratios(quality.counts(df, "id", F.col("t"), chunk)).collect()}
    assert all(stats[i]["is_prose"] == P.prose(got[i]) for i in got) and stats[13]["n_words"] == 0


def test_page_operators_do_not_depend_on_chunks(spark, monkeypatch):
    rows, frames, _ = corpus(5, 4, 6)
    pages, frames = spark.createDataFrame(rows + [(r[0] + 500 if r[0] else r[0], *r[1:]) for r in page_rows()[0]] + [(2, *rows[3][1:])], PAGE), spark.createDataFrame(frames, FRAME)
    both = []
    for chunk in (1 << 17, 300):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        r = review.Review(pages, frames)
        both.append([sorted(map(tuple, df.collect())) for df in (r.list_pages(), r.keyword_pages(), r.boilerplate_lines(), r.residue_origins())])
    assert both[0] == both[1]


def test_prose_of_unknown_languages_is_prose():
    text = "\n".join("Koj tswv yuav tuaj pom peb lub tsev nyob ntawm ntug dej, thiab peb yuav noj mov ua ke. Hnub no ntuj qhuav heev ces peb mus ua teb." for _ in range(5))
    assert P.prose(P.counts(P.read(text)[0])) and not P.prose(P.counts(P.read("a1 | 22 | 33\n" * 9)[0])) and not P.prose(P.counts(P.read("")[0]))


# ---------------------------------------------------------------- 7


def brute_repeats(rows):
    key = lambda x: re.sub(r"[\W\d_]+", "", re.sub(r"(?<![^\W\d_])(?:january|february|march|april|may|june|july|august|september|october|november|december)(?![^\W\d_])", "", x.lower()))
    where = defaultdict(set)
    for _, url, _, content in rows:
        if url and content:
            for x in content.split("\n"):
                if key(x):
                    where[quality.site_of(url), key(x)].add(url)
    return {(i, n) for i, url, _, content in rows if url and content for n, x in enumerate(content.split("\n"), 1) if key(x) and len(where[quality.site_of(url), key(x)]) >= 5}


@pytest.mark.parametrize("seed", range(4))
def test_repeated_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["Foot 12 may", "FOOT, May 3!", "foot", "Maybe", "mayMay x", "1 2 3", "", "May", "ünï code", "Ünï  Code.", "rare", "x" * 5000] + [f"own {i}" for i in range(10)]
    urls = [f"{rng.choice(['http://', 'https://www.'])}{h}{rng.choice(['', ':8080'])}/p{i}" for h in ("a.test", "A.test", "b.test") for i in range(9)]
    rows = [(i, rng.choice([*urls, None]), None, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9))) if rng.random() < 0.95 else None) for i in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, PAGE).withColumn("h1", F.lit("clash"))
    assert {tuple(r) for r in repeats.repeated_lines(df).collect()} == brute_repeats(rows)
    gone = {r["page_id"]: r["content"] for r in repeats.without_lines(df, repeats.repeated_lines(df)).collect()}
    bad = brute_repeats(rows)
    for i, _, _, c in rows:
        assert gone[i] == (None if c is None else "\n".join(x for n, x in enumerate(c.split("\n"), 1) if (i, n) not in bad))


def test_sequences_grow_from_frequent_prefixes(spark):
    rows = [(i, f"http://a.test/{i}", None, "alpha\nbeta\n\ngamma\nown " + "abcdefg"[i]) for i in range(6)] + [(9, "http://a.test/9", None, "gamma\nalpha")]
    got = Counter((r["length"], r["n_urls"]) for r in repeats.frequent_sequences(spark.createDataFrame(rows, PAGE)).collect())
    assert got == {(1, 7): 2, (1, 6): 1, (2, 6): 2, (3, 6): 1}


def test_sequences_of_any_length_equal_brute_force(spark):
    rng = random.Random(6)
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    rows = [(i, f"http://{'ab'[i % 2]}.test/{i % 17}", None, "\n".join([*names[rng.randrange(3) : rng.randrange(7, 11)], *rng.choices(names, k=4)])) for i in range(40)]
    rows += rows[:3]
    where = defaultdict(set)
    for _, url, _, content in rows:
        x = content.split("\n")
        for n in range(1, len(x) + 1):
            for a in range(len(x) - n + 1):
                where[quality.site_of(url), tuple(x[a : a + n])].add(url)
    want = Counter((len(k), len(us)) for (_, k), us in where.items() if len(us) >= 5)
    assert max(n for n, _ in want) > 6
    got = repeats.frequent_sequences(spark.createDataFrame(rows, PAGE)).collect()
    assert Counter((r["length"], r["n_urls"]) for r in got) == want and all(len(r["pattern"]) == r["length"] for r in got)
    assert len({(r["site"], tuple(r["pattern"])) for r in got}) == len(got)


def test_lines_of_sequences_are_those_of_round_one(spark):
    """What frequent sequences of any length would delete is what single lines delete."""
    rng = random.Random(8)
    names = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, f"http://a.test/{i % 11}", None, "\n".join(rng.choices(names + ["own " + "abcdefghij"[i % 10]], k=7))) for i in range(30)]
    df = spark.createDataFrame(rows, PAGE)
    ids = {h for r in repeats.frequent_sequences(df).collect() for h in r["pattern"]}
    occ = repeats.lines(df).collect()
    assert {(r["page_id"], r["line_no"]) for r in occ if r["h1"] in ids} == {tuple(r) for r in repeats.repeated_lines(df).collect()}


@pytest.mark.parametrize("least", [3, 10_000])
def test_repeated_lines_on_either_path(spark, monkeypatch, least):
    from sluiceway.operators import skew

    monkeypatch.setattr(skew, "HOT_LEAST", least)
    monkeypatch.setattr(skew, "HOT_PARTS", 100)
    rows = [(i, f"http://a.test/{i}", None, "hot line\nwarm " + "ab"[i % 2] + "\nown " + "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, PAGE)
    assert {tuple(r) for r in repeats.repeated_lines(df).collect()} == brute_repeats(rows)


def test_sequences_longer_than_the_rounds_between_cuts(spark):
    block = "\n".join("line " + chr(97 + i // 26) + chr(97 + i % 26) for i in range(35))
    got = Counter(r["length"] for r in repeats.frequent_sequences(spark.createDataFrame([(i, f"http://a.test/{i}", None, block) for i in range(5)], PAGE)).collect())
    assert got == {n: 36 - n for n in range(1, 36)}


# ---------------------------------------------------------------- 8


def brute_leaks(docs, items, run):
    grams = defaultdict(set)
    texts = {i: leaks.words_of(t) for i, t in items}
    joined = {i: " " + " ".join(w) + " " for i, w in texts.items()}
    for i, w in texts.items():
        for s in range(len(w) - run + 1):
            grams[tuple(w[s : s + run])].add(i)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        for i, x in texts.items():
            for s in range(len(x) - run + 1):
                for e in range(s + run, len(x) + 1):
                    part = " " + " ".join(x[s:e]) + " "
                    if part in " " + " ".join(w) + " " and not any(part in joined[j] for j in joined if j != i):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    shared = [rng.choice(words) for _ in range(14)]
    items = [(i, " ".join((shared if i % 2 else []) + [rng.choice(words) for _ in range(rng.randrange(4, 18))])) for i in range(8)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(30))]
        src = rng.choice(items[:8])[1].split()
        a = rng.randrange(len(src))
        part = src[a : a + rng.randrange(6, 30)]
        if rng.random() < 0.3 and part:
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(base) + 1)
        text = " ".join(base[:at] + part + base[at:])
        docs.append((d, text.upper().replace(" ", rng.choice([" ", "  ", "\n", ", "]))))
    docs += [(200, None), (201, ""), (None, items[0][1]), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string")).filter("own").collect()}
    assert got == brute_leaks([d for d in docs if d[0] is not None and d[1]], [i for i in items if i[1]], leaks.RUN)


def test_edited_passages_are_candidates():
    rng = random.Random(3)
    item = [f"t{rng.randrange(10**6)}" for _ in range(60)]
    ix = leaks.Index([(1, " ".join(item))])
    assert ix.recall >= leaks.RECALL
    hit = 0
    for _ in range(200):
        at = rng.randrange(52)
        w = item[at : at + 8]
        w[rng.randrange(8)] = "other"
        hit += len(ix.candidates(leaks._code(w, ix.number), np.array([0]))) > 0
    assert hit >= 0.8 * 200


@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted"])
def test_passages_with_one_edit_of_any_kind_are_leaks(spark, kind):
    rng = random.Random(4)
    item = [f"t{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for d in range(60):
        at, cut = rng.randrange(50), rng.randrange(1, 8)
        w = item[at : at + 9]
        w[cut : cut + (kind != "inserted")] = [] if kind == "deleted" else ["other"]
        docs.append((d, " ".join(w)))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert len(got) >= 0.8 * 60 and all(r["edits"] == 1 and not r["own"] for r in got)


def test_end_to_end_recall_of_edited_passages():
    """Passages of 10, 12 and 16 words with one edit of each kind, between other words, at any place."""
    rng = random.Random(11)
    items = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60)))) for i in range(40)]
    ix = leaks.Index(items)
    for n in (10, 12, 16):
        for kind in ("replaced", "inserted", "deleted"):
            hit = 0
            for _ in range(60):
                k = rng.randrange(40)
                w = items[k][1].split()
                a, j = rng.randrange(len(w) - n + 1), rng.randrange(1, n - 1)
                part = w[a : a + n]
                part[j : j + (kind != "inserted")] = [] if kind == "deleted" else ["other"]
                doc = [f"z{x}" for x in range(rng.randrange(20))] + part + ["y"] * 9
                codes = leaks._code(doc, ix.number)
                starts = np.arange(0, len(doc) - ix.window + 1, ix.stride)
                pairs = ix.candidates(codes, starts).tolist()
                hit += any(ix.ids[ix.owner[q]] == k and ix.verify(codes, doc, 0, len(doc), int(starts[p]), int(ix.owner[q]), int(ix.start[q]))[0] >= 0 for p, q in pairs)
            assert hit >= 0.9 * 60, (n, kind, hit)


def test_an_index_below_its_recall_is_refused(monkeypatch):
    monkeypatch.setattr(leaks, "MOST_REPEATS_SHIFTED", 2)
    with pytest.raises(ValueError, match="recall"):
        leaks.Index([(1, " ".join(f"w{i}" for i in range(40)))])


def test_too_many_items_are_refused_before_they_are_fetched(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_WORDS", 30)
    items = spark.createDataFrame([(1, "x " * 40)], "item_id bigint, text string")
    with pytest.raises(ValueError, match="words"):
        leaks.leaks(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "doc_id", "text", items)


def test_leaks_of_items_with_the_same_text(spark):
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, text), (2, text), (3, "other words")], "item_id bigint, text string")
    got = leaks.leaks(spark.createDataFrame([(7, "so " + text + " it is")], "doc_id bigint, text string"), "doc_id", "text", items).collect()
    assert sorted(tuple(r) for r in got) == [(7, 1, 20, 0, False), (7, 2, 20, 0, False)]


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(docs, "doc_id", "text", items).count() == 0
    assert leaks.leaks(docs.limit(0), "doc_id", "text", spark.createDataFrame([(1, "x " * 20)], items.schema)).count() == 0


def test_edit_distance():
    d = lambda a, b, k: leaks.edit_distance(np.array([ord(c) for c in a]), np.array([ord(c) for c in b]), k)
    assert d("kitten", "sitting", 3) == 3 and d("kitten", "sitting", 2) == -1 and d("abc", "abc", 0) == 0 and d("abc", "abd", 1) == 1 and d("abcd", "bcde", 2) == 2


# ---------------------------------------------------------------- 9


def test_temperature_meets_the_entropy():
    tokens = {"a": 1000.0, "b": 100.0, "c": 10.0, "d": 0.0}
    for h in (0.4, 0.8, 1.0):
        w = mixing.temperature_weights(tokens, h)
        assert abs(mixing.entropy(list(w.values())) - h) < 1e-6 and "d" not in w and w["a"] > w["b"] > w["c"]
    assert mixing.temperature_weights({}, 1.0) == {}


def test_plans():
    tokens = {"a": 1000, "b": 100, "c": 50}
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 4), "none": (0.1, 1)}
    t, w, budget = mixing.plan(tokens, targets)
    assert t == 1.0 and abs(sum(w.values()) - 1) < 1e-9 and abs(w["a"] / w["b"] - 5 / 3) < 1e-9 and abs(budget * w["b"] - 200) < 1e-6
    t, w, budget = mixing.plan(tokens, targets, 900)
    assert 0 < t < 1 and budget == 900 and all(900 * w[s] <= tokens[s] * targets[s][1] * 1.001 for s in w)
    t, w, budget = mixing.plan(tokens, targets, 10_000)
    assert budget == 1000 + 200 + 200 and abs(w["a"] * budget - 1000) < 1e-6
    assert mixing.plan({}, targets)[1] == {}


def test_drawn_shares(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.randint(1, 200)) for i, s in enumerate(["a"] * 3000 + ["b"] * 200 + ["c"] * 5 + ["d"] * 9)] + [(9001, None, 5), (9002, "a", 0)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("A ", 0.6, 1), ("b", 0.3, 3), ("c", 0.02, 8), ("gone", 0.08, 1), ("b", 0.9, 9)], "source string, target_share double, max_repeats int")
    drawn, plan = mixing.draw(counts, targets)
    got = drawn.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    total = sum(r["n_tokens"] * r["repeats"] for r in got)
    limits = {"a": 1, "b": 3, "c": 8}
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.02)):
        mine = [r for r in got if r["source"] == s]
        assert max(r["repeats"] for r in mine) <= limits[s]
        assert abs(sum(r["n_tokens"] * r["repeats"] for r in mine) / total - share / 0.92) < 0.004
    rep = {r["source"]: r for r in mixing.report(drawn, counts, targets.limit(4)).collect()}
    assert rep["gone"]["reached_share"] == 0 and rep["gone"]["tokens"] == 0 and abs(sum(r["reached_share"] for r in rep.values()) - 1) < 1e-5
    assert mixing.draw(counts.limit(0), targets)[0].count() == 0


def test_a_mix_as_large_as_its_sources_bisects_the_exponent(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(1, 50)) for i, s in enumerate(["a"] * 900 + ["b"] * 100 + ["c"] * 20 + ["d"] * 50)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    budget = mixing.listed_tokens(counts, targets)
    assert budget == sum(n for _, s, n in rows if s != "d")
    drawn, plan = mixing.draw(counts, targets, budget)
    got = drawn.collect()
    assert 0 < plan["exponent"] < 1 and abs(sum(r["n_tokens"] * r["repeats"] for r in got) - budget) < 0.01 * budget
    most = {"a": 2, "b": 2, "c": 3}
    assert all(r["repeats"] <= most[r["source"]] for r in got)
    rep = {r["source"]: r for r in mixing.report(drawn, counts, targets, plan["exponent"]).collect()}
    assert rep["b"]["reached_share"] > sum(n for _, s, n in rows if s == "b") / budget and 0 < rep["a"]["exponent"] < 1


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    counts = spark.createDataFrame([(i, "abc"[i], 1) for i in range(3)], "doc_id bigint, source string, n_tokens bigint")
    with pytest.raises(ValueError, match="sources"):
        mixing.source_sizes(counts)


@pytest.mark.parametrize("text", ["word two, three  four\n\n five" * 40, "x" * 700, "a b\t\tc " * 90, " " * 300 + "end", "été naïve 東京 " * 50])
def test_tokens_do_not_depend_on_pieces(monkeypatch, text):
    whole = len(mixing._encoder(mixing.TOKENIZER).encode_ordinary(text))
    for piece in (5, 64, 10_000):
        monkeypatch.setattr(mixing, "_PIECE", piece)
        assert mixing.count_tokens(text) == whole


def test_token_counts(spark):
    df = spark.createDataFrame([(1, " A ", "hello hello"), (1, " A ", "hello hello"), (2, None, None), (None, "a", "x"), (3, "b", "word " * 60_000)], "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit(7))
    got = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in mixing.token_counts(df).collect()}
    assert got[1] == ("a", 2) and got[2] == (None, 0) and 60_000 <= got[3][1] <= 60_010 and set(got) == {1, 2, 3}


# ---------------------------------------------------------------- 10


def make_docs(seed, n=240):
    rng = random.Random(seed)
    vocabulary = {la: blocks.STOP_WORDS[la].split() for la in ("en", "de", "fr", "pl")}
    own = {la: [f"{la}{''.join(rng.choice(dict(en='thwo', de='schk', fr='eaux', pl='czyw')[la]) for _ in range(4))}" for _ in range(60)] for la in vocabulary}
    sentence = lambda la: " ".join(rng.choice(vocabulary[la] if rng.random() < 0.5 else own[la]) for _ in range(8)).capitalize() + "."
    docs, truth = [], {}
    for i in range(n):
        la = rng.choice(list(vocabulary))
        second = rng.choice(list(vocabulary)) if rng.random() < 0.3 else la
        a, b = rng.randint(3, 8), rng.randint(2, 4)
        text = " ".join(sentence(la) for _ in range(a)) + "\n" + " ".join(sentence(second) for _ in range(b))
        label = rng.choice([la, la, la, la.upper(), {"en": "English", "de": "de-AT", "fr": "fra", "pl": "pol"}[la], None, "xx", "", rng.choice(list(vocabulary))])
        docs.append((i, text, label))
        named = languages.label_code(label)
        truth[i] = {x for x in (la, second) if x != named}
    return docs, truth


def test_languages_on_made_up_documents(spark):
    docs, truth = make_docs(1)
    df = spark.createDataFrame([*docs, (1000, None, "en"), (1001, "", None), (1002, "12 34 !", None), (None, docs[0][1], None), docs[0]], "doc_id bigint, text string, lang string").withColumn("segment", F.lit(1))
    model = languages.fit_on(df, "doc_id", "text", "lang")
    assert model.langs == ["de", "en", "fr", "pl"]
    got = defaultdict(set)
    for r in languages.unnamed_languages(df, "doc_id", "text", "lang", model).collect():
        got[r["doc_id"]].add(r["lang"])
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.97 * len(truth) and not {1000, 1001, 1002, None} & set(got)
    segs = languages.segments(df.filter("doc_id = 3"), "doc_id", "text", model).orderBy("segment").collect()
    assert segs[0]["start"] == 0 and segs[-1]["end"] == len(docs[3][1]) and all(0 < s["confidence"] <= 1 for s in segs)
    per = languages.document_languages(languages.segments(df, "doc_id", "text", model)).filter("doc_id = 3").collect()
    assert abs(sum(r["share"] for r in per) - 1) < 1e-5


def test_strange_languages_are_unknown(spark):
    docs, _ = make_docs(4)
    df = spark.createDataFrame([*docs, (900, "Το παλιό γεφύρι της πόλης είναι κλειστό. Κανείς δεν είπε γιατί έγινε αυτό.", "el"), (901, "古い橋は閉鎖されている。", None)], "doc_id bigint, text string, lang string")
    model = languages.fit_on(df.filter("doc_id < 900"), "doc_id", "text", "lang")
    got = {(r["doc_id"], r["lang"]) for r in languages.segments(df, "doc_id", "text", model).collect()}
    assert {x for x in got if x[0] >= 900} == {(900, "und"), (901, "und")} and not any(la == "und" for i, la in got if i < 900)
    assert not [r for r in languages.unnamed_languages(df, "doc_id", "text", "lang", model).collect() if r["doc_id"] >= 900]


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, PROSE, None), (2, PROSE, "zz")], "doc_id bigint, text string, lang string")
    assert languages.unnamed_languages(df, "doc_id", "text", "lang", languages.fit_on(df, "doc_id", "text", "lang")).count() == 0
    assert languages.segments(df.limit(0), "doc_id", "text", languages.fit_on(df.limit(0), "doc_id", "text", "lang")).count() == 0


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "eng": "en", "English": "en", "en_US": "en", "fr-CA": "fr", "swe": "sv", "ger": "de", "xx": None, "": None, "und": None, "??": None, " pt-BR ": "pt", None: None, "-": None}
    assert {k: languages.label_code(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in df.select("l", languages.label_code_column(F.col("l"))).collect()} == cases


def test_a_quoted_phrase_is_no_sentence_of_its_language():
    docs, _ = make_docs(2)
    model = languages.fit([(languages.label_code(la), t) for _, t, la in docs if languages.label_code(la)])
    sums = languages.Scorer(model).sums(["the of le la les des une the of".split(), "le la les une des".split()])
    assert [model.langs[i] for i in sums.argmax(axis=1)] == ["en", "fr"]
