"""Pseudonyms, licence scan and preference rows."""

from __future__ import annotations

import random
import re
from itertools import product

import pytest

from marktext.llm import licenses as L
from marktext.llm.chat_pairs import CLOSE, OPEN, format_preferences, preference_rows
from marktext.llm.pii import _iban_mod, feistel, luhn_digit, pseudonymise, pseudonymise_documents

KEY = b"k" * 32


@pytest.mark.parametrize("radixes", [[10, 10, 10], [3, 5, 7], [2, 26, 10], [256, 3], [1, 26]])
def test_feistel_is_a_keyed_permutation(radixes):
    every = list(product(*map(range, radixes)))
    out = {tuple(feistel(list(x), radixes, KEY, "t")) for x in every}
    assert out == set(every)
    for x in every[:50]:
        assert tuple(feistel(feistel(list(x), radixes, KEY, "t"), radixes, KEY, "t", undo=True)) == x
    assert [feistel(list(x), radixes, b"other" * 6, "t") for x in every] != [feistel(list(x), radixes, KEY, "t") for x in every]


CASES = {
    "card 4111 1111-1111 1111!": r"card 4\d{3} \d{4}-\d{4} \d{4}!",
    "+1 (743) 555-3824": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "from 152.143.123.131, ok": r"from \d+\.\d+\.\d+\.\d+, ok",
    "to hein.19@mail5.example.com.": r"to [a-z]{4}\.\d{2}@mail5\.example\.com\.",
    "born 1987-02-28 or 28.02.1987": r"born \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4}",
    "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d",
    'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!': r'TOKEN = "[0-9A-F]{40}"!!',
    "ssn 123-45-6789": r"ssn \d{3}-\d{2}-\d{4}",
    "on February 28, 1987": r"on [A-Z][a-z]+ \d{1,2}, \d{4}",
}


@pytest.mark.parametrize("text", CASES)
def test_formats(text):
    new, spans = pseudonymise(text, KEY)
    assert new != text and re.fullmatch(CASES[text], new) and spans
    assert pseudonymise(text, KEY)[0] == new
    for s in spans:
        assert text[s["start"]:s["stop"]] not in new


def test_pseudonyms_are_valid_again():
    new = pseudonymise("4316522678525456", KEY)[0]
    d = [int(c) for c in new]
    assert luhn_digit(d[:-1]) == d[-1]
    iban = pseudonymise("GB82WEST12345698765432", KEY)[0]
    assert _iban_mod(iban[4:] + iban[:4]) == 1 and iban[:2] == "GB"
    days = [pseudonymise(f"{y}-02-28", KEY)[0] for y in range(1950, 2050)]
    assert len(set(days)) == 100 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in days)


def test_equal_values_stay_linked_across_formats():
    a = pseudonymise("4111111111111111", KEY)[0]
    assert pseudonymise("4111 1111 1111 1111", KEY)[0].replace(" ", "") == a
    one, two = pseudonymise("1987-02-28 / 28.02.1987", KEY)[0].split(" / ")
    assert one.split("-") == two.split(".")[::-1]
    assert pseudonymise("Ab.c@x.org", KEY)[0].lower() == pseudonymise("ab.C@x.org", KEY)[0].lower()


@pytest.mark.parametrize("text", ["", "plain words", "2123465659789240 is no card", "300.1.2.3", "version 1.2.3", "2021-13-45",
                                  "CC BY-NC 4.0.", "12345", "000-12-3456", "a@b", "DE88 3704 0044 0532 0130 00", "1.2.3.4.5"])
def test_what_is_not_valid_stays(text):
    assert pseudonymise(text, KEY) == (text, [])


@pytest.mark.parametrize("before, value, after", [
    ("", "4111 1111 1111 1111", " 123"), ("", "4111 1111 1111 1111", " 12/27"), ("", "4111111111111111", " 10 times"),
    ("1 ", "4111111111111111", ""), ("12 345 ", "4111-1111-1111-1111", " 99 1"), ("1234 5678 9012 3456 7890 1234 ", "4111 1111 1111 1111", ""),
    ("", "BE68 5390 0754 7034", " EUR"), ("", "AT61 1904 3002 3457 3201", " BIC"), ("", "DE89370400440532013000", " EUR 20"),
    ("IBAN ", "GB82 WEST 1234 5698 7654 32", " AND BIC"), ("AB12 CDEF GH34 ", "BE68 5390 0754 7034", "")])
def test_values_next_to_more_digits_or_words(before, value, after):
    new, spans = pseudonymise(before + value + after, KEY)
    assert [(s["start"], s["stop"]) for s in spans] == [(len(before), len(before + value))]
    assert new.startswith(before) and new.endswith(after) and value not in new and spans[0]["pseudonym"] == pseudonymise(value, KEY)[0]


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "a." * 150_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "-" * 300_000):
        pseudonymise(text, KEY)


def test_pii_tables(spark):
    rows = [(1, "mail a.b@c.org", "x"), (1, "mail a.b@c.org", "x"), (2, None, "x"), (3, "", None), (None, "call +49 30 1234567", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = pseudonymise_documents(df, "secret")
    assert out.columns == ["doc_id", "text", "kind", "spans"]
    got = out.collect()
    assert len(got) == len(rows) and len({r["text"] for r in got if r["doc_id"] == 1}) == 1
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert all(r["text"] != "call +49 30 1234567" for r in got)
    assert pseudonymise_documents(df.limit(0), "secret").count() == 0
    assert pseudonymise_documents(df.withColumnRenamed("kind", "spans"), "secret").columns == ["doc_id", "text", "spans"]


def brute_scan(text, threshold=0.8):
    """Every unit against every template, no pruning: best Dice by unit."""
    out = {}
    lines = text.split("\n")
    units = {(i, i): L.normalise(x) for i, x in enumerate(lines)}
    full = [i for i, x in enumerate(lines) if L.normalise(x)]
    if full:
        units[full[0], full[-1]] = L.normalise(text)
    for at, words in units.items():
        from collections import Counter
        a = Counter(zip(words, words[1:]))
        for name, texts in L.TEMPLATES.items():
            for t in texts:
                w = L.normalise(t)
                b = Counter(zip(w, w[1:]))
                if a and 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) >= threshold:
                    out.setdefault(at, []).append((-2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())), name))
    return {at: min(v)[1] for at, v in out.items()}


def test_license_scan_matches_brute_force():
    rnd = random.Random(1)
    index = L.TemplateIndex(L.TEMPLATES, 0.8)
    names = [t for ts in L.TEMPLATES.values() for t in ts]
    for _ in range(150):
        words = rnd.choice(names).split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "the", words[0].upper()])
        text = " ".join(words) + rnd.choice(["", "\nother words here", "!!"])
        if rnd.random() < 0.3:
            text = "first line\n" + text
        got = {(m["first_line"], m["last_line"]): m["license"] for m in L.scan_text(text, index)}
        want = brute_scan(text)
        assert got.items() <= want.items()
        assert set(got.values()) == set(want.values())


def test_license_of_wrapped_text_and_tables(spark):
    words = L.TEMPLATES["MIT"][-1].split()
    wrapped = "\n".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9))
    rows = [(1, f"Copyright 2020 A. Person\n\n{wrapped}\n\nint main() {{}}", "x"), (2, "Licensed under CC BY-NC 4.0.", "x"), (3, None, "x"),
            (4, "", None), (4, "", None), (5, "licensed under nothing at all", "x"), (6, "w " * 50000, "x")]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).withColumn("best", L.main_license())
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["best"]["l"] == "MIT" and (by[1]["best"]["f"], by[1]["best"]["t"]) == (2, 2 + wrapped.count("\n"))
    assert by[2]["best"]["l"] == "CC-BY-NC-4.0" and by[5]["best"] is None and by[3]["licenses"] == [] and got.count() == len(rows)
    again = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    assert L.scan_licenses(again).where("size(licenses) > 0").count() == 2 and L.scan_licenses(again.limit(0)).count() == 0


NOTICES = {
    "MIT": ("Permission is hereby", "The above copyright", "THE SOFTWARE IS"),
    "GPL-3.0": ("This program is free", "This program is distributed"),
    "Apache-2.0": ("Licensed under the", "Unless required"),
}


def in_paragraphs(name, prefix="", width=9):
    """The notice wrapped to lines, with its usual blank lines."""
    text = next(t for t in L.TEMPLATES[name] if t.startswith(NOTICES[name][0]) and NOTICES[name][-1] in t)
    cuts = [text.index(x) for x in NOTICES[name]] + [len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        words = text[a:b].split()
        out += [" ".join(words[k:k + width]) for k in range(0, len(words), width)] + [""]
    return [(prefix + x).rstrip() for x in out[:-1]]


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
@pytest.mark.parametrize("name", NOTICES)
def test_license_notice_in_its_paragraphs_inside_a_long_text(name, prefix):
    rnd = random.Random(3)
    prose = [" ".join(rnd.choices("the of a parser reads this software in any form and then writes lines".split(), k=12)) for _ in range(300)]
    notice = in_paragraphs(name, prefix)
    text = "\n".join([*prose[:150], "", "Copyright 2020 A. Person", *notice, "", *prose[150:]])
    got = L.scan_text(text, L.TemplateIndex(L.TEMPLATES, 0.8))
    best = min(got, key=lambda m: -m["dice"])
    assert {m["license"] for m in got} == {name} and best["dice"] == 1
    assert (best["first_line"], best["last_line"]) == (152, 151 + len(notice))


def gnu_notice(work, name, version, end):
    return (f"This {work} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {name}\nas published "
            f"by the Free Software Foundation; either version {version}\nof the License, or (at your option) any later version.\n\n"
            f"This {work} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied "
            f"warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {name} for more details.{end}")


FAMILY = {"GPL-2.0": ("program", "General Public License", "2"), "GPL-3.0": ("program", "General Public License", "3"),
          "AGPL-3.0": ("program", "Affero General Public License", "3"), "LGPL-2.1": ("library", "Lesser General Public License", "2.1"),
          "LGPL-3.0": ("library", "Lesser General Public License", "3")}


@pytest.mark.parametrize("closing", [False, True])
@pytest.mark.parametrize("name", FAMILY)
def test_license_family_members_are_told_apart(name, closing):
    work, title, version = FAMILY[name]
    end = f"\n\nYou should have received a copy of the GNU {title}\nalong with this {work}.  If not, see <https://www.gnu.org/licenses/>."
    text = gnu_notice(work, title, version, end if closing else "")
    for whole in (text, text.replace("\n", " "), f"int a;\n\n{text}\n\nint main() {{}}\n" + "return a b c d\n" * 200):
        got = L.scan_text(whole, L.TemplateIndex(L.TEMPLATES, 0.8))
        assert min(got, key=lambda m: -m["dice"])["license"] == name


def test_license_bsd_texts_are_told_apart():
    two, three = max(L.TEMPLATES["BSD-2-Clause"], key=len), max(L.TEMPLATES["BSD-3-Clause"], key=len)
    index = L.TemplateIndex(L.TEMPLATES, 0.8)
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (two[:two.index("THIS SOFTWARE IS")], "BSD-2-Clause")):
        for t in (text, "Copyright 2020 A. Person\n\n" + text.replace(": 1.", ":\n\n1.").replace(". 2.", ".\n\n2.").replace(". 3.", ".\n\n3.")):
            assert min(L.scan_text(t, index), key=lambda m: -m["dice"])["license"] == name


def test_license_runs_are_each_found_once_in_linear_time():
    index = L.TemplateIndex(L.TEMPLATES, 0.8)
    parts = [in_paragraphs(n) for n in NOTICES]
    text = "\n".join(x for _ in range(20) for p in parts for x in [*p, "", "int main() {}"])
    assert [m["license"] for m in L.scan_text(text, index) if m["dice"] == 1] == list(NOTICES) * 20
    words = " ".join(x for p in parts for x in p).split()
    assert {m["license"] for m in L.scan_text("\n".join(words), index)} >= set(NOTICES)  # a word a line
    L.scan_text("of the\n" * 20_000, index)
    L.scan_text("the software\n" * 20_000, index)


TALKS = "conv_id long, turn long, role string, text string, extra int"


def test_preference_pairs_match_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(60):
        rnd.seed(c // 2)  # siblings draw the same turns until they part
        turns = [("system", f"s{c // 2}")] + [(("user", "assistant")[k % 2], f"t{k} {rnd.randrange(5)} é") for k in range(rnd.randrange(1, 8))]
        part = rnd.randrange(1, len(turns) + 1)
        if c % 2:
            turns = turns[:part] + [("assistant", f"other {c}")] * (c % 3)
        rows += [(c, k, r, t, 1) for k, (r, t) in enumerate(turns)]
    talk = {c: [(r, t) for cc, _, r, t, _ in rows if cc == c] for c in range(60)}
    got = preference_rows(spark.createDataFrame(rows, TALKS)).collect()
    pairs = [r for r in got if r["rejected_id"] is not None]
    assert len(pairs) == 30
    render = lambda ts: "".join(f"{OPEN}{r}\n{t}{CLOSE}" for r, t in ts)
    for r in pairs:
        a, b = talk[r["chosen_id"]], talk[r["rejected_id"]]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert r["n_common"] == n and r["prompt"] == render(a[:n])
        assert r["chosen_text"] == render(a[n:]) and r["rejected_text"] == render(b[n:])
        for text, mask, turns in ((r["chosen_text"], r["chosen_mask"], a[n:]), (r["rejected_text"], r["rejected_mask"], b[n:])):
            assert [text[m["start"]:m["stop"]] for m in mask] == [t + CLOSE.strip() for who, t in turns if who == "assistant"]
        said = lambda ts: sum(len(t) for who, t in ts if who == "assistant")
        assert (-said(a), r["chosen_id"]) < (-said(b), r["rejected_id"])


def test_preference_singles_hot_openings_and_awkward_rows(spark, monkeypatch):
    from marktext.llm import chat_pairs
    monkeypatch.setattr(chat_pairs, "BUCKET", 10)
    rows = [(c, k, ("user", "assistant")[k % 2], "hello" if k == 0 else f"reply {c}", 1) for c in range(101) for k in range(2)]
    rows += [(500, 0, "user", "only a question", 1), (501, 0, "user", "q", 1), (501, 1, "assistant", None, 1), (501, 1, "assistant", None, 1),
             (501, None, None, "late", 1), (None, 0, "user", "x", 1), (502, 0, "user", "q2", 1), (502, 1, "assistant", "a" * 50000, 1),
             (502, 2, "user", "more", 1), (502, 3, "assistant", "b", 1)]
    got = preference_rows(spark.createDataFrame(rows, TALKS)).collect()
    used = [i for r in got for i in (r["chosen_id"], r["rejected_id"]) if i is not None]
    assert sorted(used) == [*range(101), 501, 502], "every conversation with a reply once"
    assert all(r["n_common"] == 1 for r in got if r["rejected_id"] is not None)
    by = {r["chosen_id"]: r for r in got}
    assert by[502]["n_common"] == 3 and "a" * 50000 in by[502]["rejected_text"] and "b" in by[502]["chosen_text"]
    empty = spark.createDataFrame([], TALKS)
    assert preference_rows(empty).count() == 0


def test_equal_sides_and_prefixes(spark):
    said = "pair long, turn long, said array<struct<role:string,text:string>>"
    u, a = [("user", "u")], [("assistant", "a")]
    left = spark.createDataFrame([(1, 0, u), (1, 1, a), (2, 0, u)], said)
    right = spark.createDataFrame([(1, 0, u), (1, 1, a), (2, 0, u), (2, 1, a)], said)
    got = {r["pair"]: r for r in format_preferences(left, right).collect()}
    assert got[1]["n_common"] == 2 and got[1]["chosen_text"] == got[1]["rejected_text"] == ""
    assert got[2]["n_common"] == 1 and got[2]["chosen_text"] == "" and got[2]["rejected_mask"]


def test_secrets_without_a_digit_are_found():
    from marktext.llm.pii import pseudonymise
    for value in ("deadbeefcafebabe", "ABCDEFABCDEFABCD"):
        for text in (f"password: {value}", f"token={value}", f"password: {value} 7"):
            new, spans = pseudonymise(text, b"key")
            assert value not in new and value.lower() not in new.lower() and len(new) == len(text) and [s["kind"] for s in spans] == ["secret"]
