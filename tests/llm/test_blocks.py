"""Lines, pages, chunks and automata: the plain functions against hand-made cases and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.llm import blocks as B
from sluiceway.llm import automaton, boilerplate, keywords, templates
from sluiceway.llm import pages as P
from sluiceway.llm.automaton import repeat_cover
from sluiceway.llm.quality import site_of

BODY = [
    "Then the market settled.", "A cookie notice is the first thing most visitors see, said the owner, who has collected one hundred of them.", "You had to sign up for the letter by post, she recalls, and all rights to the drawings stayed in town.",
    "By then the varnish had arrived, because the owner had cleaned every cabinet in the evening.", "In the end, the tram improved, because one visitor had repaired every bridge almost by accident.", "How the owner painted the bridge", "Der Bäcker kennt das neue Dach, weil die Nachbarin die Brücke beschreibt.",
]


@pytest.mark.parametrize("line", BODY)
def test_body_lines(line):
    assert B.kind(line)[0] in (B.PROSE, B.SHORT)


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("", B.BLANK), ("   ", B.BLANK), ("a b   12.5   n/a   7%", B.TABLE), ("abba | gold | silver", B.TABLE), ("var a = {b: 1};", B.CODE), ("    x = call(3, 'y')", B.CODE), ("[31/08 17:20] a.b#2 rc=8 0xf5616fc7 X", B.LOG), ("q1W2e3" * 12, B.JUNK),
        ("{}[]<>^%$#@!*&~`|", B.JUNK), ("- item of a list", B.ITEM), ("3. item", B.ITEM), ("Ð½ÐµÐ¼ÑÃ Ð¾Ð±ÑÃ ÑÃ", B.JUNK), ("The old bridge", B.SHORT),
    ],
)
def test_kinds(line, kind):
    assert B.kind(line)[0] == kind


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_any_line_has_a_kind(line):
    k, n, s = B.kind(line)
    assert 0 <= k <= 8 and 0 <= s <= n


def brute_cover(words, least, longest=None):
    """Characters covered by substrings that occur ``least`` times, by comparing all of them."""
    n = len(words)
    hit = [False] * n
    for i in range(n):
        for j in range(i + 1, n + 1):
            sub = words[i:j]
            if (longest is None or j - i >= longest) and sum(words[k : k + j - i] == sub for k in range(n - (j - i) + 1)) >= least:
                hit[i:j] = [True] * (j - i)
    return sum(len(w) for w, h in zip(words, hit, strict=True) if h)


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice("a bb ccc d ee".split()) for _ in range(rng.randrange(25))]
    got = repeat_cover(words, [len(w) for w in words])
    assert got == (brute_cover(words, 2), brute_cover(words, 2, 2), brute_cover(words, 3))


@pytest.mark.parametrize("seed", range(60))
def test_array_of_huge_pages_equals_the_automaton(seed):
    rng = random.Random(seed)
    words = [rng.choice("a b c d".split()[: rng.randint(1, 4)]) for _ in range(rng.randrange(1, 60))]
    assert automaton._array_marks(words) == tuple(map(list, automaton.repeat_marks(words))) == automaton._automaton_marks(words)


def test_repeats_count_across_pages_of_any_length(monkeypatch):
    words = [f"w{i}" for i in range(300)] * 2
    monkeypatch.setattr(automaton, "AUTOMATON_WORDS", 100)
    assert repeat_cover(words, [1] * 600) == (600, 600, 0)


LINES = ["The old bridge of the town is closed, and nobody has said why it was.", "- an item", "a  1  2  3", "", "   ", "Home | About", "x" * 90, "var a = {b: 1};", "word " * 700, "ab" * 1500, "the " * 600 + "end.", "naïve, ünïcode: the text of it."]


PADDED = [" " * 1500 + "a  1  2  3" + " " * 1500, " " * 2500 + "The old bridge", "[31/08 17:20] " + "x.y#2 rc=0 " * 400, "a = b[1]; " * 300, "1 2 3 " * 500, "\t" * 90 + "- an item"]


@pytest.mark.parametrize("seed", range(80))
def test_chunks_merge_to_the_facts_of_the_whole(seed):
    rng = random.Random(seed)
    text = "\n".join(rng.choice(LINES + PADDED) for _ in range(rng.randrange(12)))
    cut = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(9))) if seed % 2 else list(range(700, len(text), 700))
    parts = [P.partial(text[a:b]) for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
    while len(parts) > 1:  # any tree
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [P.merge(parts[i], parts[i + 1])]
    assert P.finish(parts[0]) == P.read(text) and P.finish(parts[0])[1] == text.split("\n")


@pytest.mark.parametrize("line", ["x = b[1]; ", "[31/08 17:20] a.b rc=0 ", "lamp | 1 | 2 | 3 | ", "The old bridge of the town is closed, and nobody has said why. "])
def test_kinds_do_not_change_with_length(line):
    assert len({B.kind((line * n).strip())[0] for n in (3, 30, 300, 3000)}) == 1


def keyword(text, links=None):
    facts, lines = P.read(text)
    if not any(facts):
        return keywords.keyword_page([], links)
    solid, long, often = P.cover(facts)
    rows = [f for f in facts if f]
    return keywords.keyword_page([(f[0], f[1], f[3], f[4], f[5], f[6], a, b, c, f[7]) for f, a, b, c in zip(rows, solid, long, often, strict=True)], links)


def test_stuffed_pages_and_what_they_are_not():
    spam = " | ".join(["cheap red lamp", "red lamp", "best red lamp", "red lamp sale"] * 12)
    tags = "\n".join(", ".join(f"{k} N{i}{j}x" for j, k in enumerate(["lamp", "sofa", "kayak", "lamp"] * 3)) for i in range(8))
    hashes = "\n".join(" ".join(f"#{k}{s}" for k in ("lamp", "sofa", "kettle") for s in ("love", "sale")) for _ in range(6))
    addresses = "\n".join(f"n{i}x-bridge.example" for i in range(14))  # no floor of words for links
    prose = " ".join(f"The keeper of the lamp said that the lamp was number {i}, and nobody asked why it had been so." for i in range(20))
    plain = "\n".join(f"N{i}x lamp (old)" for i in range(30))
    table = "\n".join(f"N{i} mill | {i * 37} | n/a | {i * 3}% | {i}.5 | -" for i in range(30))
    code = "\n".join("if (a == b) { call(a, b); }" for _ in range(30))
    assert all(map(keyword, (spam, tags, hashes, addresses)))
    assert not any(map(keyword, (prose, plain, table, code, "", "lamp lamp lamp")))
    assert keyword(plain, links=0.9) and not keyword(prose, links=0.9)


def test_line_links_align_frames_by_bytes():
    f = lambda n, x: (n, x)
    assert keywords.line_links([5, 7, 3], [f(12, 4), f(3, None)]) == [(0, 2, 4), (2, 3, None)]
    assert keywords.line_links([5, 7], [f(11, 4)]) == [] and keywords.line_links([5], None) == [] and keywords.line_links([], []) == []
    assert keywords.link_share([5, 7], [B.SHORT, B.BOILER], [f(5, 5), f(7, 0)]) == 1.0
    assert keywords.link_share([5], [B.SHORT], [f(10, 5)]) == 0.5 and keywords.link_share([5], [B.SHORT], []) is None


def test_second_pass_inherits_from_neighbours():
    body, short, bad = B.PROSE, B.SHORT, B.BOILER
    run = lambda kinds: boilerplate.second_pass([10] * len(kinds), kinds, None)
    assert run([bad, short, body, short, body, short, short, bad]) == [True, False, False, False, False, True, True, True]
    assert run([body, short, bad, body]) == [False, False, True, False]  # a subhead while the body goes on
    assert run([body, short, bad]) == [False, True, True]  # a link after its end
    assert run([short, short]) == [False, False] and run([]) == [] and run([body, short, short, short]) == [False, True, True, True]
    frames = [(20, 19), (10, 0)]
    assert boilerplate.second_pass([10, 10, 10], [short, short, short], frames) == [True, True, False]


STORY = "\n".join(["The old bridge of the town is closed, and nobody has said why it was so for a year."] * 14)


def origin(title, content):
    facts, lines = P.read(content or "")
    page = P.page("", title, facts, lines)
    return templates.origins(page[1], page[8], list(range(len(page[2]))), page[6], [{} for _ in range(len(page[2]) + 1)])


@pytest.mark.parametrize(
    ("title", "content", "found"),
    [
        ("Hi", "Dear {{first_name}}, the bridge is open.", True), (None, "Written by [INSERT AUTHOR HERE]", True), ("%(page.title)s | Site", "The bridge of the town is open, and it was so.", True), ("Hi", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do.", True),
        ("Hi", "Your text goes here. Click to edit.", True), ("Untitled", "The bridge of the town is open.", True), ("X", "404 Not found\nThe page you requested is not here.", True), ("X", "You need to enable JavaScript to run this app.", True), ("X", "Seite nicht gefunden", True),
        ("What a 404 page says about X", "The status 404 means that a server could not find what was asked for, and " + "the keeper has collected drawings of such pages since 1990, as nobody had before. " * 12, False),
        ("Templates, {{site_name}} and X", "A template engine turns a mark such as {{ heading }} into the value that the writer had in mind, and nobody saw it. " * 3, False),
        ("History", "In the example, #{excerpt} stands for the name of the reader; the book explains how the value is looked up.", False), ("The old bridge", "Printers used to set lorem ipsum as filler because nobody reads it, which was a strange habit of the town.", False),
        (None, None, False), ("", "  \n ", False), (None, "The old bridge of the town is open, and nobody has said why.", False),
    ],
)
def test_residue(title, content, found):
    assert (origin(title, content) > 0) is found


@pytest.mark.parametrize("line", [
    "Dear [CUSTOMER NAME], the bridge is open.", "Dear $name$, the bridge is open.", "Dear FIRSTNAME LASTNAME, welcome to COMPANY.", "Hello , your appointment is on  at .", "Welcome, null! You have undefined new messages.",
    "Posted by undefined on NaN/NaN/NaN", "Hello *|FNAME|*, the bridge is open.", "Your order %ORDER_ID% is on its way.", "Hallo {vorname}, wir haben deine Nachricht.", "Cher <<prenom>>, le pont est ouvert.",
])
def test_unseen_placeholders_blanks_and_defaults(line):
    assert origin("The bridge", STORY + "\n" + line)


@pytest.mark.parametrize("line", ["Nothing  on  Fosmer is advice.", "Site  map  |  Terms", "In  the  end, it was so.", "He wrote null on the form.", "The NASA and the UNESCO agreed.", "Il dit : « oui » !", "a  table  of  12"])
def test_doubled_spaces_and_capitals_are_no_blanks(line):
    assert not origin("The bridge", STORY + "\n" + line)


def test_sites():
    assert site_of("HTTPS://www.A.test:80/x") == "a.test" and site_of("b.test?x") == "b.test" and site_of(None) is None and site_of("") is None


def test_keys_are_those_of_templates():
    units = lambda s, host="": [k for k, _ in P.line_facts(s, host)[8]]
    assert units("Page of Anna took 33 ms") == units("page of Bob took 7 ms") != units("Page of Anna cost 33 ms")
    assert units("Fosmer is published by hand", "fosmer.test") == units("Kelver is published by hand", "kelver.test")
    assert units("123 456") == [] and P.line_facts("Filed under: a, b", "")[9] == P.line_facts("Filed under: c", "")[9] != 0
    assert P.title_key(None) == 0 and P.title_key("Page not found | Anna", "anna.test") == P.title_key("Page not found")


def test_very_long_and_odd_texts():
    for text in ("x" * 3_000_00, "the old bridge " * 20_000, "\n" * 5000, "\u0000\ud7ff", "{{" * 5000, "[" * 20_000, "a " * 50_000 + "\n" + "- " * 9000, "<a" * 20_000, "lamp sofa " * 5000):
        facts, lines = P.read(text)
        assert len(P.counts(facts)) == P.WIDTH and len(facts) == len(lines)
        P.page("a.test", text[:500], facts, lines)


@pytest.mark.parametrize("notice", [
    "Warning: mysql_connect(): Access denied for user 'web'@'localhost' in /var/www/db.php on line 12", "Error establishing a database connection", "Please enable JavaScript to view the comments.", "404 Not Found",
    "You need to enable JavaScript to run this app.", "JavaScript is disabled in your browser.", "The requested URL was not found on this server.", "It opened again in May. Please enable JavaScript to see the map.",
])
def test_messages_count_in_pages_of_any_length(notice):
    assert origin("The bridge", STORY + "\n" + notice + "\n" + STORY) == templates.BY_FORM


@pytest.mark.parametrize("line", [
    "Many people browse with JavaScript switched off, so every page works without scripts.", "The status 404 means that a server could not find what was asked for.", "JavaScript is required in many courses of the school.",
    "A notice such as Please enable JavaScript tells readers what is missing.", "Built with a hand-made script and hosted on one small machine", "The error was found on line 12 of the letter.", "Then the server says:\n404 Not Found",
])
def test_long_articles_about_messages_stay(line):
    assert origin("The bridge", STORY + "\n" + line + "\n" + STORY) == 0


def test_error_titles_count_over_texts_of_any_length():
    assert origin("404 Not Found", STORY) == templates.BY_WORDS and origin("Bridge | Page not found", STORY) == templates.BY_WORDS
    assert origin("Forbidden", STORY) == 0 and origin("The bridge", STORY) == 0


@pytest.mark.parametrize("n", [0, 1, 3, 30, 300])
def test_slots_and_sentences_count_in_lines_of_any_length(n):
    story = "The old bridge of the town is closed, and nobody has said why it was so for a year. " * n
    assert origin("The bridge", STORY + "\n" + story + "Hello , your appointment is on  at . " + story)
    assert origin("The bridge", STORY + "\n" + "<li>lamp sofa</li> " * n + "<li>{{first_name}}</li>")
    units = lambda s: dict(P.line_facts(s, "")[8])
    letter = units(story + "Dear Anna, we wrote to you of Kelver. " + story)
    assert letter.items() >= units("Dear Bob, we wrote to you of Fosmer.").items() and P.FILLED_AT in letter.values()
    mixed = units(story + "Dear , we wrote to you. We saw Anna at the mill.")
    assert sorted(mixed.values())[-2:] == [P.BLANK_AT, P.FILLED_AT]  # the sentence with the blank alone is blank
    assert P.line_facts("Text " + "text " * (n + 30) + "text", "")[5] & P.FILLER


def test_odd_signs_far_apart_leave_no_slot_open():
    story = "The old bridge of the town is closed, and nobody has said why it was so for a year. " * 6
    assert not origin("The bridge", STORY + "\nHe wrote null on the form. " + story + "She wrote undefined on it. " + story)


def test_the_automaton_is_built_over_all_words_of_every_page(monkeypatch):
    real, built = automaton._automaton, []
    monkeypatch.setattr(automaton, "_automaton", lambda words: (built.append(len(words)), real(words))[1])
    pages = [["lamp", "sofa", "mill", "lamp", "tram"], ["red", "lamp"] * 9, [f"w{i}" for i in range(automaton.AUTOMATON_WORDS)] * 2]
    assert [repeat_cover(x, [1] * len(x)) for x in pages] == [(2, 0, 0), (18, 18, 18), (100_000, 100_000, 0)]
    assert built == [len(x) for x in pages]


@pytest.mark.parametrize(
    "line",
    [
        "Error 404", "404 - the thing is gone", "Status code: 5001", "The page you asked for could not be found", "This file no longer exists", "We were unable to load it", "No such page", "Not found", "Cookies must be enabled",
        "Please enable JavaScript", "Bitte schalten Sie JavaScript ein", "This account has been suspended", "Your session has expired", "Too many requests", "Access denied", "You do not have permission", "Members only", "This needs an account",
        "Not available in your country", "Down for maintenance", "Undergoing an upgrade", "It will be back soon", "Service temporarily unavailable", "It did not respond", "The call timed out", "Try once more", "Stack trace", "Fatal error",
        "Undefined index", "Memory size", "Unexpected token", "The request failed", "Empty response", "Exception thrown in it", "Index of /", "Parent directory", "Checking your browser", "Prove that you are human", "Just a moment",
        "Unusual traffic", "Captcha", "Loading...", "Your browser is too old", "Something broke", "Oops", "Broken link", "Go to the start page", "Home page", "Die Seite existiert nicht", "Nicht gefunden", "La page a été DÉPLACÉE", "Introuvable",
        "La página no existe", "Pagina non trovata", "Pagina niet gevonden", "Sidan hittades inte", "Strona nie istnieje", "Страница не найдена", "Try again at the \u212aiosk", "Thi\u017f \u017fite i\u017f parked", "A walk by the river", "",
    ],
)
def test_hints_leave_out_no_error_message(line):
    for x in (line, line.upper(), f"It said: {line} \u00e9", line.replace("s", "\u017f").replace("k", "\u212a")):
        assert P._reads_as_error(x) == any(p.search(x) is not None for p in (P._ERROR_CODE, P._ERROR_GONE, P._ERROR_OTHER))
    assert P._reads_as_error(line) == (line not in ("A walk by the river", ""))


def test_reading_for_residue_leaves_out_only_what_others_ask():
    rng = random.Random(4)
    odd = ["don't", "'tis", "dogs'", "a''b", "snake_case", "x|y;z", "#tag", "404", "\u00e9t\u00e9", "\u0130zmir", "Anna", "null", ",", ".", "1\u00a0000", "https://a.test/b", "{name}", "it.", "So?", "Yes!"]
    for _ in range(3000):
        line = rng.choice([" ", "  ", "\t"]).join(rng.choice(odd + BODY[1].split()) for _ in range(rng.randrange(1, 30)))
        light, full = P.line_facts(line, "a.test", False), P.line_facts(line, "a.test")
        assert light[:5] == full[:5] and light[5] == full[5] & ~P.ITEMS and light[6:8] == (0, 0) and light[8:] == full[8:]
        assert full[10] == P._W.findall(line.lower())
        parts, words, _ = P._words(line, line.lower(), " ".join(line.split()), full[0])
        assert words == [P._W.findall(x) for x in parts] and len(parts) in (1, len(P._SENTENCE.split(" ".join(line.split()))))
