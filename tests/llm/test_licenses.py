"""Phrases and templates against plain searches."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from brindle.llm.licenses import (
    PHRASES,
    TEMPLATES,
    Automaton,
    Matcher,
    scan,
    scan_licenses,
    words_of,
)
from brindle.llm.queries import NAMED_LICENSES, QUERIES
from brindle.sources import Tables

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base(text, phrases=PHRASES):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i:i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def as_pattern(template):
    """The template as a regular expression over space-joined words."""
    parts = []
    for mark, gap, wording in re.findall(
            r"(\{\{|\}\})|<<(\d+)>>|((?:(?!\{\{|\}\}|<<).)+)", template):
        if mark:
            parts.append("(?:" if mark == "{{" else ")?")
        elif gap:
            parts.append(r"(?:\S+ ){0,%s}" % gap)
        else:
            parts += [re.escape(w) + " " for w in WORD.findall(lowered(wording))]
    return re.compile("(?<= )" + "".join(parts))


def labels(text):
    line = " " + "".join(w + " " for w in WORD.findall(lowered(text)))
    found = {label for label, ts in TEMPLATES.items() for t in ts if as_pattern(t).search(line)}
    return ",".join(sorted(found | set(base(text)[4].split(",")) - {""}))


def check(text):
    n_words, n_base, first, last, base_labels, all_labels, score = scan(text)
    assert (n_words, n_base, first, last, base_labels) == base(text), text
    assert all_labels == labels(text), text
    assert 0 <= score <= 1 and (score == 1) == bool(all_labels)


def test_edges():
    for text in [None, "", " ", "the mit license", "The MIT-License the mit license",
                 "the mit licensed", "Ünder the MIT License x", "\x00the\x7fmit license",
                 "cc by nc" * 3, "apache license version 2.0 cc by-nc", "mit license " * 5000,
                 "This work is licensed under the GNU General Public License, version 3.",
                 "permission is hereby granted", "ǅ 1 ½ ０"]:
        check(text)


def test_random_mixtures_of_template_words():
    rng = random.Random(3)
    words = sorted({w.decode() for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            template = rng.choice([t for ts in TEMPLATES.values() for t in ts])
            chosen = re.sub(r"\{\{(.*?)\}\}", lambda m: m[1] if rng.random() < .5 else "", template)
            chosen = re.sub(r"<<\d+>>", lambda m: " ".join(rng.choices(words, k=rng.randint(0, 3))),
                            chosen)
            chosen = chosen.split()
            if rng.random() < .4 and len(chosen) > 1:
                chosen[rng.randrange(len(chosen))] = rng.choice(words)
            parts += chosen
        check(" ".join(parts))


def share(automaton, words, at):
    """The share of the mandatory words met by one run from word ``at``; 1.0: accepted."""
    states, best = automaton.closed({0}), 0
    for step, word in enumerate(words[at:at + 400]):
        # a run begins with a word that is told, never with any word
        states = {t for s in states for w, t in automaton.edges[s]
                  if w == word or (w is None and step)}
        if not states:
            break
        states = automaton.closed(states)
        if automaton.end in states:
            return 1.0
        best = max(best, max(automaton.met[s] for s in states))
    return best / automaton.mandatory


def plainly(templates, words):
    """Labels and score by a run from every word of every template."""
    found, score = set(), 0.0
    for label, wordings in templates.items():
        for automaton in map(Automaton, wordings):
            best = max((share(automaton, words, at) for at in range(len(words))), default=0.0)
            score = max(score, best)
            found |= {label} if best == 1 else set()
    return found, score


def test_an_automaton_counts_what_it_has_met():
    matcher = Matcher({"x": ["a b {{c}} <<2>> d"]})
    assert matcher.match([b"a", b"b", b"x", b"y", b"d"]) == ({"x"}, 1)
    assert matcher.match([b"a", b"b", b"x", b"y", b"z"]) == (set(), 2 / 3)
    assert matcher.match([b"a", b"b", b"d"]) == ({"x"}, 1)
    assert matcher.match([b"b"]) == matcher.match([]) == (set(), 0)


def test_one_pass_finds_what_a_run_from_every_word_finds():
    rng = random.Random(5)
    templates = {"x": ["a b {{c d}} <<2>> a b"], "y": ["{{a}} b <<1>> {{b {{a}} c}} d", "c c a"],
                 "z": ["a {{<<2>> b}} a c"]}
    for most in (0, 50_000):
        matcher = Matcher(templates, most)
        for _ in range(1500):
            words = rng.choices([b"a", b"b", b"c", b"d", b"e"], k=rng.randint(0, 14))
            assert matcher.match(words) == plainly(templates, words), words
    whole = [t for ts in TEMPLATES.values() for t in ts]
    for _ in range(60):
        words = [w for _ in range(3) for w in words_of(
            re.sub(r"\{\{|\}\}|<<\d+>>", " ", rng.choice(whole)))[:rng.randint(3, 60)]]
        labels_, score = plainly(TEMPLATES, words)
        assert scan(b" ".join(words).decode())[-2:] == (
            ",".join(sorted(labels_ | set(filter(None, base(b" ".join(words).decode())[4].split(","))))),
            1.0 if base(b" ".join(words).decode())[4] else score)


def test_whole_wording_has_to_be_whole():
    for label in ("mit-full", "isc-full", "bsd-2-full", "bsd-3-full"):
        text = re.sub(r"<<\d+>>", "some one", re.sub(r"\{\{(.*?)\}\}", r"\1", TEMPLATES[label][0]))
        assert label in scan("Copyright 2020 x\n\n" + text + "\nmore")[5].split(",")
        words = text.split()
        for changed in ([*words[:40], "never", *words[40:]], words[:-1], words[1:],
                        [*words[:-9], "no", *words[-8:]]):
            found = scan(" ".join(changed))
            assert label not in found[5].split(",")
    assert scan(TEMPLATES["bsd"][0])[5] == "bsd"


def test_time_grows_with_the_length():
    rng = random.Random(1)
    words = sorted({w.decode() for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    text = " ".join(rng.choice(words) for _ in range(160_000)) + " the mit license" * 20_000
    scan(text[:1000])
    seconds = []
    for times in (1, 8):
        begin = time.process_time()
        found = scan(" ".join([text] * times))
        seconds.append(time.process_time() - begin)
        assert found[1] == 20_000 * times
    assert len(text * 8) > 10 ** 7 and seconds[1] < 20 and seconds[1] < 16 * seconds[0] + 1, seconds


def test_columns_rows_and_empty_tables(spark, documents):
    df = documents([(1, "the mit license"), (1, "the mit license"), (None, None)])
    df = df.withColumns({"score": F.lit("own"), "odd.name": F.lit(1)})
    found = scan_licenses(df, "text")
    assert found.count() == 3 and "odd.name" in found.columns
    assert sorted(r.labels for r in found.collect()) == ["", "mit", "mit"]
    assert scan_licenses(documents([]), "text").count() == 0


def test_the_query_on_a_whole_table(spark, medium):
    texts = {r.doc_id: r.text for r in Tables(spark, medium).documents.collect()}
    rows = QUERIES["op10_license_templates"](spark, medium).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == base(texts[r.doc_id], NAMED_LICENSES)
        assert r.labels == labels(texts[r.doc_id])


def test_the_score_of_a_text_without_a_templates_longest_word():
    text = "licensed under a Creative Commons Attribution 4.0 License"
    assert scan(text)[-2:] == ("", 5 / 7)
    check(text)


def test_the_query_counts_the_phrases_that_its_contract_names(spark, documents, tmp_path):
    texts = {
        1: "Released under the MIT License.", 2: "This is the MIT license, and the MIT license",
        3: "x under the mit license under the MIT-License; Apache License, Version 2.0 CC BY-NC",
        4: "under\nThe\tMIT\x7fLicense", 5: "under the MIT licensed", 6: None, 7: "",
        8: "under the under the mit license", 9: "Ünder the mit license \x85 under\u2028the mit license",
    }
    documents([*texts.items(), (None, "under the mit license")]).write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in
            QUERIES["op10_license_templates"](spark, str(tmp_path)).collect()}
    assert rows.keys() == {*texts, None}
    assert rows[1] == (5, 1, 1, 1, "mit", "mit", 1.0)
    assert rows[2] == (9, 0, None, None, "", "mit", 1.0)  # a label of the method's own
    assert rows[3][1:5] == (4, 1, 14, "apache-2,cc-by-nc,mit")
    assert rows[4][1:5] == rows[None][1:5] == (1, 0, 0, "mit") and rows[8][1:4] == (1, 2, 2)
    wanted = {"under the mit license": "mit", "apache license version 2": "apache-2",
              "cc by nc": "cc-by-nc"}
    for doc_id, text in texts.items():
        assert rows[doc_id][:5] == base(text, wanted), text
