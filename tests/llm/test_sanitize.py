import hashlib
import math
import random
import re
from collections import Counter

from tessera.llm.sanitize import GENERALISE, REACH, REMOVE, find_personal_data, sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


CASES = [
    "mail a.b@c.de and x@y.z%q@r.st end", "@a.b a@b a@b.c.d-e.f. é🎉 z@z.zz", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "12345678901234567890 5500005555555559x",
    "+1 (234) 567-8901 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++49 30 1234567-", "\x01a@b.cd\x01", "7" * 3000, "1.1.1." * 500, "a" * 5000 + "@b.cd", "9 " * 4000, "+1" + "." * 3000 + "2", None, "",
]


def test_base_spans_against_plain_python(docs_of):
    rnd = random.Random(2)
    parts = ["a@b.c", "@", ".", "x", "1", "22", "256", " ", "-", "+", "(", ")", "4111111111111111", "%", "é", "🎉", "\n"]
    cases = CASES + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    for r in find_personal_data(docs_of(list(enumerate(cases)))).collect():
        found = plain(cases[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (cases[r.doc_id], text, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[3] == k for f in found) for k in PATTERNS]
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] in PATTERNS] == [x for x in text.split(",") if x]


def secrets():
    """An address that three documents share, with a word that only these have, and a word that all have."""
    rows = [(i, f"filler{i % 7} words common here about zebrafish contact jo@x.org please") for i in range(3)]
    return rows + [(10 + i, f"filler{i % 7} words common here about nothing") for i in range(60)]


def test_terms_that_reveal(spark, docs_of):
    docs = docs_of(secrets())
    found = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    texts = dict(secrets())
    for i in range(3):
        kinds = {texts[i][int(a) : int(b)]: k for k, a, b in (x.split(":") for x in found[i].split(","))}
        assert kinds["zebrafish"] == "term" and kinds["jo@x.org"] == "email"
        assert "common" not in kinds and "words" not in kinds
    assert all(not s for i, s in found.items() if i >= 10)
    made = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "zebrafish" not in made[0] and "[email]" in made[0] and "[term]" in made[0]
    assert made[10] == texts[10]
    assert sanitise(docs).columns == docs.columns


WORD = re.compile(r"[^\W_]+")


def plain_spans(texts):
    """text -> all spans, by plain counts over the distinct texts."""
    texts = {t or "" for t in texts}
    base = {t: plain(t) for t in texts}
    clear = {}
    for t in texts:
        letters = list(t)
        for s, _, e, _ in base[t]:
            letters[s:e] = " " * (e - s)
        clear[t] = "".join(letters)
    where = {t: [(m.start(), m.end(), m[0]) for m in WORD.finditer(clear[t])] for t in texts}
    n, of_term, of_entity, both = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        of_term.update({w for _, _, w in where[t]})
        of_entity.update({(k, t[s:e]) for s, _, e, k in base[t]})
        # a term that begins (or ends) at the window's edge may go on beyond it, so it does not count
        near = {((k, t[s:e]), w) for s, _, e, k in base[t] for a, b, w in where[t] if (s - REACH < a or s <= REACH) and (s - REACH <= a and b <= s or e <= a and b <= e + REACH and (b < e + REACH or len(t) <= e + REACH))}
        both.update(near)
    found: dict = {}
    for (entity, term), k in both.items():
        share = of_entity[entity] / n
        chance = (k + share / 2) / (of_term[term] + 0.5)
        if chance > 0.5 and share < 1:
            found[term] = max(found.get(term, 0), math.log(chance / share) / -math.log(share))
    out = {}
    for t in texts:
        method = [(a, 5, b, "term") if found[w] >= REMOVE else (a, 6, b, "hint") for a, b, w in where[t] if found.get(w, 0) >= GENERALISE]
        out[t] = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base[t] + method))
    return out


def test_all_spans_against_plain_counts(docs_of):
    """Random texts with entities of one and several texts, copies, terms near and far, and terms elsewhere."""
    rnd = random.Random(21)
    common = [f"word{i}" for i in range(30)]
    people = [(f"Name{i}", f"n{i}@mail.org") for i in range(12)] + [("李", "+1 234 567 89 01"), ("Li", "10.2.3.4"), ("K77", "4111 1111 1111 1111")]
    texts = []
    for i in range(300):
        words = [rnd.choice(common) for _ in range(rnd.randint(1, 60))] + [f"rare{rnd.randint(0, 400)}"]
        if i % 3 == 0:
            name, mail = rnd.choice(people)
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice([[name, mail], [mail, "x" * 110, name], [name, ".", mail, mail], [mail]])
        if i % 40 == 7:
            words.append(rnd.choice(people)[0])
        texts.append(rnd.choice([" ", "  ", ", "]).join(words))
    texts += rnd.sample(texts, 40) + [None, ""]
    right = plain_spans(texts)
    assert sum("term" in s or "hint" in s for s in right.values()) > 20
    for r in find_personal_data(docs_of(list(enumerate(texts)))).collect():
        assert r.spans == right[texts[r.doc_id] or ""], texts[r.doc_id]


def test_copies_like_their_original(docs_of):
    """Copies are redacted as their single original would be, and rare words far from entities stay."""
    far = "quixotic marmalade lanterns " + "common words here about nothing " * 10
    rows = [(0, far + "mail jo@x.org now"), (1, far + "mail jo@x.org now")] + [(10 + i, f"common words here about nothing mail now filler{i % 7}") for i in range(60)]
    two = {r.doc_id: r.text for r in sanitise(docs_of(rows)).collect()}
    one = {r.doc_id: r.text for r in sanitise(docs_of(rows[1:])).collect()}
    assert two[0] == two[1] == one[1] == far + "mail [email] now"


def test_odd_rows(odd, empty):
    assert find_personal_data(odd).count() == odd.count()
    assert find_personal_data(empty).count() == 0
    same = sorted(map(str, odd.select("doc_id", "text").collect()))
    assert sorted(map(str, sanitise(odd).select("doc_id", "text").collect())) == same


def test_short_names_and_numbers_reveal(docs_of):
    card = "4111111111111112"  # fails the Luhn test, so no base span
    rows = [(i, f"filler{i} words common Li and K77 {card} contact jo@x.org please") for i in range(3)]
    rows += [(10 + i, f"filler{i % 7} words common and nothing contact please") for i in range(60)]
    made = {r.doc_id: r.text for r in sanitise(docs_of(rows)).collect()}
    assert all(x not in made[i].split() for i in range(3) for x in ("Li", "K77", card))
    assert all(x in made[i].split() for i in range(3) for x in ("words", "common", "and"))


def test_entities_of_one_text(spark, docs_of):
    rows = [(0, "common words here about zebrafish contact jo@x.org"), (1, "common words here about zebrafish contact jo@x.org"), (2, "common words here about heliotrope contact al@x.org")]
    rows += [(10 + i, f"common words here about contact filler{i}") for i in range(60)]
    made = {r.doc_id: r.text for r in sanitise(docs_of(rows)).collect()}
    assert made[0] == made[1] == made[2] == "common words here about [term] contact [email]"
    assert all(made[i] == t for i, t in rows if i >= 10)


def test_terms_reveal_in_every_text(docs_of):
    rows = [(i, f"common words here about zebrafish contact jo@x.org filler{i}") for i in range(8)]
    rows += [(8, "common words here about zebrafish alone"), (9, "common words here about zebrafish and al@x.org")]
    rows += [(10 + i, f"common words here about contact and alone filler{i}") for i in range(900)]
    made = {r.doc_id: r.text for r in sanitise(docs_of(rows)).collect()}
    assert all("zebrafish" not in made[i] and "common words here about" in made[i] for i in range(10))
    assert made[8] in ("common words here about [term] alone", "common words here about [word] alone")
