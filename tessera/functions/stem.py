"""Stemmers. English: Porter's algorithm, as published, with one deviation that the tests name. Danish, Dutch, Finnish,
French, German, Italian, Norwegian, Portuguese, Russian, Spanish and Swedish: the published Snowball algorithms."""

from __future__ import annotations

VOWELS = "aeiou"

#: Suffixes of steps 2 to 4 and what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _consonants(word: str) -> list[bool]:
    """Whether each letter is a consonant: y is one at the start and after a vowel."""
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in VOWELS and (c != "y" or i == 0 or not out[i - 1]))
    return out


def _measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    kinds = _consonants(stem)
    return sum(kinds[i] and not kinds[i - 1] for i in range(1, len(kinds)))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _short_end(stem: str) -> bool:
    """Consonants, one vowel, one consonant other than w, x, y, and no more than that."""
    kinds = _consonants(stem)
    return len(stem) > 2 and _measure(stem) == 1 and kinds[-1] and not kinds[-2] and all(kinds[:-2]) and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix) and len(word) > len(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The Porter stem of a lower-case English word.

    One deviation: in step 4, -sion and -tion are endings as a whole: the s or t goes too, and does not count in the
    measure.
    """
    if len(word) < 3:
        return word
    if word.endswith("sses") or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed") and len(word) > 3:
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = next((s for s in ("ing", "ed") if word.endswith(s) and len(word) > len(s)), "")
        stem = word[: len(word) - len(ending)]
        if ending and _has_vowel(stem):
            word = stem
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiouylsz":
                word = word[:-1]
            elif _short_end(word):
                word += "e"
    if word.endswith("y") and len(word) > 1 and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    suffix = next((s for s in STEP4 if word.endswith(s) and len(word) > len(s)), "")
    if suffix:
        if _measure(word[: -len(suffix)]) > 1:
            word = word[: -len(suffix)]
    elif word.endswith(("sion", "tion")) and len(word) > 4 and _measure(word[:-4]) > 1:
        word = word[:-4]
    if word.endswith("e") and len(word) > 1:
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes: list[str], region: int) -> str:
    """The longest of the suffixes that lies in the region; empty if none does."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= region), key=len, default="")


def _drop(word: str, suffix: str) -> str:
    return word[: len(word) - len(suffix)]


NORDIC_VOWELS = {"swedish": "aeiouyäåö", "danish": "aeiouyæåø", "norwegian": "aeiouyæåø"}

#: Endings of the Nordic stemmers' first step, letters before a final s, and the pairs of the second.
NORDIC_ENDINGS = {
    "swedish": "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split(),
    "danish": "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split(),
    "norwegian": "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split(),
}
NORDIC_BEFORE_S = {"swedish": "bcdfghjklmnoprtvy", "danish": "abcdfghjklmnoprtvyzå", "norwegian": "bcdfghjlmnoprtvyz"}
NORDIC_PAIRS = {"swedish": ["dd", "gd", "nn", "dt", "gt", "kt", "tt"], "danish": ["gd", "dt", "gt", "kt"], "norwegian": ["dt", "vt"]}


def _nordic_start(word: str, language: str) -> tuple[str, int]:
    vowels = NORDIC_VOWELS[language]
    region = max(3, _region(word, vowels))
    endings = NORDIC_ENDINGS[language] + ["s"] + (["erte", "ert"] if language == "norwegian" else [])
    found = _longest(word, endings, region)
    if found in ("erte", "ert"):
        word = _drop(word, found) + "er"
    elif found == "s":
        before = word[-2:-1]
        if before in NORDIC_BEFORE_S[language] or (language == "norwegian" and before == "k" and word[-3:-2] not in vowels):
            word = word[:-1]
    else:
        word = _drop(word, found)
    return word, region


def _nordic_pair(word: str, language: str, region: int) -> str:
    return word[:-1] if _longest(word, NORDIC_PAIRS[language], region) else word


def swedish(word: str) -> str:
    word, region = _nordic_start(word, "swedish")
    word = _nordic_pair(word, "swedish", region)
    found = _longest(word, ["lig", "ig", "els", "löst", "fullt"], region)
    return word[:-1] if found in ("löst", "fullt") else _drop(word, found)


def norwegian(word: str) -> str:
    word, region = _nordic_start(word, "norwegian")
    word = _nordic_pair(word, "norwegian", region)
    return _drop(word, _longest(word, "leg eleg ig eig lig elig els lov elov slov hetslov".split(), region))


def danish(word: str) -> str:
    word, region = _nordic_start(word, "danish")
    word = _nordic_pair(word, "danish", region)
    if word.endswith("igst"):
        word = word[:-2]
    found = _longest(word, ["ig", "lig", "elig", "els", "løst"], region)
    if found == "løst":
        word = word[:-1]
    elif found:
        word = _nordic_pair(_drop(word, found), "danish", region)
    if len(word) > region and word[-1] == word[-2] and word[-1] not in NORDIC_VOWELS["danish"] and len(word) - 1 >= region:
        word = word[:-1]
    return word


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    word = word.replace("ß", "ss")
    letters = list(word)
    for i in range(1, len(letters) - 1):
        if letters[i] in "uy" and letters[i - 1] in vowels and letters[i + 1] in vowels:
            letters[i] = letters[i].upper()
    word = "".join(letters)
    first = _region(word, vowels)
    r1, r2 = max(3, first), _region(word, vowels, first)
    found = next((s for s in sorted(["em", "ern", "er", "e", "en", "es", "s"], key=len, reverse=True) if word.endswith(s)), "")
    if found and len(word) - len(found) >= r1 and (found != "s" or word[-2:-1] in "bdfghklmnrt"):
        word = _drop(word, found)
        if found in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    found = next((s for s in ["est", "en", "er", "st"] if word.endswith(s)), "")
    if found and len(word) - len(found) >= r1 and (found != "st" or (len(word) > 5 and word[-3] in "bdfghklmnt")):
        word = _drop(word, found)
    found = next((s for s in ["isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"] if word.endswith(s)), "")
    if found and len(word) - len(found) >= r2:
        stem = _drop(word, found)
        if found in ("end", "ung"):
            word = stem
            if word.endswith("ig") and len(word) - 2 >= r2 and not word.endswith("eig"):
                word = word[:-2]
        elif found in ("ig", "ik", "isch"):
            word = word if stem.endswith("e") else stem
        elif found in ("lich", "heit"):
            word = stem
            if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                word = word[:-2]
        else:
            word = stem
            tail = next((s for s in ("lich", "ig") if word.endswith(s) and len(word) - len(s) >= r2), "")
            word = _drop(word, tail)
    return word.lower().translate(str.maketrans("äöü", "aou"))


#: The endings of the Russian stemmer. Those of a first group count only after а or я.
RU_GERUND1, RU_GERUND2 = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
RU_PARTICIPLE1, RU_PARTICIPLE2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
RU_VERB1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
RU_VERB2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    vowels = "аеиоуыэюя"
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in vowels), len(word))
    r2 = _region(word, vowels, _region(word, vowels))

    def ending(one: list[str], two: list[str]) -> str:
        found = [s for s in one if word.endswith(s) and len(word) - len(s) > rv and word[-len(s) - 1] in "ая"]
        return max(found + [s for s in two if word.endswith(s) and len(word) - len(s) >= rv], key=len, default="")

    found = ending(RU_GERUND1, RU_GERUND2)
    if found:
        word = _drop(word, found)
    else:
        word = _drop(word, ending([], ["ся", "сь"]))
        found = ending([], RU_ADJECTIVE)
        if found:
            word = _drop(word, found)
            word = _drop(word, ending(RU_PARTICIPLE1, RU_PARTICIPLE2))
        else:
            found = ending(RU_VERB1, RU_VERB2)
            word = _drop(word, found or ending([], RU_NOUN))
    word = _drop(word, ending([], ["и"]))
    word = _drop(word, _longest(word, ["ост", "ость"], r2))
    found = _longest(word, ["ейш", "ейше"], rv)
    word = _drop(word, found)
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    return word if found else _drop(word, ending([], ["ь"]))


# ---- Romance languages and Dutch, Finnish -----------------------------------------------------------------------


class Regions:
    """A word being stemmed: its text, and where its regions RV, R1 and R2 begin, which stay as the word shrinks."""

    def __init__(self, word: str, vowels: str, rv: int = 0):
        self.word, self.vowels, self.rv = word, vowels, rv
        self.r1 = _region(word, vowels)
        self.r2 = _region(word, vowels, self.r1)

    def ending(self, suffixes: list[str], region: int = 0) -> str:
        """The longest of the suffixes that lies in the region."""
        return _longest(self.word, suffixes, region)

    def within(self, suffix: str, region: int) -> bool:
        return len(self.word) - len(suffix) >= region

    def cut(self, suffix: str, region: int, instead: str = "") -> bool:
        """Replace a suffix that the word has, if it lies in the region; whether it did."""
        if self.word.endswith(suffix) and self.within(suffix, region):
            self.word = _drop(self.word, suffix) + instead
            return True
        return False

    def before(self, suffix: str) -> str:
        """The letter before a suffix."""
        return self.word[-len(suffix) - 1 : -len(suffix)]


def _marked_vowels(word: str, vowels: str, between: str, after_q: bool = False) -> str:
    """Letters of `between` that stand between vowels, and u after q, as consonants: in upper case."""
    out = list(word)
    for i, c in enumerate(word):
        if c in between and 0 < i < len(word) - 1 and out[i - 1] in vowels and word[i + 1] in vowels or after_q and c == "u" and i and out[i - 1] == "q":
            out[i] = c.upper()
    return "".join(out)


def _rv(word: str, vowels: str) -> int:
    """Where RV begins in Italian, Portuguese and Spanish."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


#: The endings of the French stemmer, by what is done with them.
FR_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_AGENT = "atrice ateur ation atrices ateurs ations".split()
FR_VERBS_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
    "issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
FR_VERBS_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_VERBS_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
FR_OTHER = "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()


def _french_suffix(w: Regions) -> tuple[bool, bool]:
    """The first step: whether it removed something, and whether verb endings are looked for all the same."""
    found = w.ending(FR_DELETE + FR_AGENT + FR_OTHER)
    if found in FR_DELETE and found:
        return w.cut(found, w.r2), False
    if found in FR_AGENT:
        done = w.cut(found, w.r2)
        if done and w.word.endswith("ic") and not w.cut("ic", w.r2):
            w.cut("ic", 0, "iqU")
        return done, False
    if found in ("logie", "logies"):
        return w.cut(found, w.r2, "log"), False
    if found in ("usion", "ution", "usions", "utions"):
        return w.cut(found, w.r2, "u"), False
    if found in ("ence", "ences"):
        return w.cut(found, w.r2, "ent"), False
    if found in ("ement", "ements"):
        if not w.cut(found, w.rv):
            return False, False
        before = w.ending(["iv", "eus", "abl", "iqU", "ièr", "Ièr"])
        if before == "iv" and w.cut("iv", w.r2):
            w.cut("at", w.r2)
        elif before == "eus" and not w.cut("eus", w.r2):
            w.cut("eus", w.r1, "eux")
        elif before in ("abl", "iqU"):
            w.cut(before, w.r2)
        elif before in ("ièr", "Ièr"):
            w.cut(before, w.rv, "i")
        return True, False
    if found in ("ité", "ités"):
        if not w.cut(found, w.r2):
            return False, False
        before = w.ending(["abil", "ic", "iv"])
        if before and not w.cut(before, w.r2) and before != "iv":
            w.cut(before, 0, {"abil": "abl", "ic": "iqU"}[before])
        return True, False
    if found in ("if", "ive", "ifs", "ives"):
        if not w.cut(found, w.r2):
            return False, False
        if w.cut("at", w.r2) and w.word.endswith("ic") and not w.cut("ic", w.r2):
            w.cut("ic", 0, "iqU")
        return True, False
    if found == "eaux":
        return w.cut(found, 0, "eau"), False
    if found == "aux":
        return w.cut(found, w.r1, "al"), False
    if found in ("euse", "euses"):
        return w.cut(found, w.r2) or w.cut(found, w.r1, "eux"), False
    if found in ("issement", "issements"):
        return w.before(found) not in w.vowels and w.cut(found, w.r1), False
    if found in ("amment", "emment"):
        return w.cut(found, w.rv, {"a": "ant", "e": "ent"}[found[0]]), True
    if found in ("ment", "ments"):
        return bool(w.before(found)) and w.before(found) in w.vowels and len(w.word) - len(found) > w.rv and w.cut(found, w.rv), True
    return False, False


def _french_verb(w: Regions) -> bool:
    found = w.ending(FR_VERBS_I, w.rv)
    if found and len(w.word) - len(found) > w.rv and w.before(found) not in w.vowels:
        return w.cut(found, w.rv)
    found = w.ending([*FR_VERBS_E, *FR_VERBS_A, "ions"], w.rv)
    if found == "ions":
        return w.cut(found, w.r2)
    done = bool(found) and w.cut(found, w.rv)
    if done and found in FR_VERBS_A:
        w.cut("e", w.rv)
    return done


def french(word: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    word = _marked_vowels(word, vowels, "ui", after_q=True)
    word = "".join("Y" if c == "y" and (i and word[i - 1] in vowels or word[i + 1 : i + 2] and word[i + 1] in vowels) else c for i, c in enumerate(word))
    if len(word) > 2 and (word[0] in vowels and word[1] in vowels or word[:3] in ("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(word)) if word[i] in vowels), len(word))
    w = Regions(word, vowels, rv)
    removed, verbs = _french_suffix(w)
    altered = removed or False
    if not removed or verbs:
        altered = _french_verb(w) or removed
    if altered:
        if w.word.endswith("Y"):
            w.word = w.word[:-1] + "i"
        elif w.word.endswith("ç"):
            w.word = w.word[:-1] + "c"
    else:
        if w.word.endswith("s") and len(w.word) > 1 and w.word[-2] not in "aiouès":
            w.word = w.word[:-1]
        found = w.ending(["ion", "ier", "ière", "Ier", "Ière", "e"], w.rv)
        if found == "ion":
            if len(w.word) - 3 > w.rv and w.before(found) in "st":
                w.cut(found, w.r2)
        elif found:
            w.cut(found, w.rv, "i" if len(found) > 1 else "")
    if w.ending(["enn", "onn", "ett", "ell", "eill"]):
        w.word = w.word[:-1]
    tail = len(w.word)
    while tail and w.word[tail - 1] not in vowels:
        tail -= 1
    if 0 < tail < len(w.word) and w.word[tail - 1] in "éè":
        w.word = w.word[: tail - 1] + "e" + w.word[tail:]
    return w.word.lower()


def _iberian_suffix(w: Regions, kinds: dict[str, list[str]], swaps: dict[str, str], ic_too: list[str], mente: list[str], before_amente: list[str]) -> bool:
    """The standard suffixes of Italian, Portuguese and Spanish."""
    found = w.ending([s for k in kinds.values() for s in k] + list(swaps) + ic_too)
    kind = next((k for k, v in kinds.items() if found in v), "")
    if found in swaps:
        return w.cut(found, w.r2, swaps[found])
    if found and found in ic_too:
        done = w.cut(found, w.r2)
        if done:
            w.cut("ic", w.r2)
        return done
    if kind == "delete":
        return w.cut(found, w.r2)
    if kind == "in rv":
        return w.cut(found, w.rv)
    if kind == "amente":
        if not w.cut(found, w.r1):
            return False
        before = w.ending(["iv", *before_amente])
        if before and w.cut(before, w.r2) and before == "iv":
            w.cut("at", w.r2)
        return True
    if kind == "mente":
        done = w.cut(found, w.r2)
        before = w.ending(mente)
        if done and before:
            w.cut(before, w.r2)
        return done
    if kind == "ity":
        done = w.cut(found, w.r2)
        before = w.ending(["abil", "ic", "iv"])
        if done and before:
            w.cut(before, w.r2)
        return done
    if kind == "ive":
        done = w.cut(found, w.r2)
        if done and w.cut("at", w.r2) and "ivi" in kinds["ive"]:
            w.cut("ic", w.r2)
        return done
    return False


#: The endings of the Spanish stemmer.
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_KINDS = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "ity": ["idad", "idades"],
    "ive": "iva ivo ivas ivos".split(),
}
ES_SWAPS = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_VERBS_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán "
    "irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron "
    "ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos "
    "amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    w = Regions(word, vowels, _rv(word, vowels))
    pronoun = w.ending(ES_PRONOUNS, w.rv)
    if pronoun:
        stem = _drop(w.word, pronoun)
        verb = _longest(stem, ["iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"], w.rv)
        if verb in ("iéndo", "ándo", "ár", "ér", "ír"):
            w.word = _drop(stem, verb) + verb.translate(_ACUTE)
        elif verb and (verb != "yendo" or stem[: -len(verb)].endswith("u")):
            w.word = stem
    if not _iberian_suffix(w, ES_KINDS, ES_SWAPS, ES_IC, ["ante", "able", "ible"], ["os", "ic", "ad"]):
        found = w.ending(ES_VERBS_Y, w.rv)
        if not (found and w.before(found) == "u" and w.cut(found, w.rv)):
            found = w.ending([*ES_VERBS, "en", "es", "éis", "emos"], w.rv)
            if found:
                w.cut(found, w.rv)
                if found in ("en", "es", "éis", "emos") and w.word.endswith("gu"):
                    w.word = w.word[:-1]
    found = w.ending("os a o á í ó e é".split(), w.rv)
    if found:
        w.cut(found, w.rv)
        if found in "eé" and w.word.endswith("gu") and len(w.word) - 1 >= w.rv:
            w.word = w.word[:-1]
    return w.word.translate(_ACUTE)


#: The endings of the Italian stemmer.
IT_PRONOUNS = [a + b for a in ("glie", "me", "te", "ce", "ve") for b in ("la", "le", "li", "lo", "ne")] + "ci gli la le li lo mi ne si ti vi sene".split()
IT_KINDS = {
    "delete": "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split(),
    "in rv": "amento amenti imento imenti".split(),
    "amente": ["amente"],
    "ity": ["ità"],
    "ive": "ivo ivi iva ive".split(),
}
IT_SWAPS = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
IT_IC = "azione azioni atore atori".split()
IT_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe "
    "erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero "
    "irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute "
    "uti uto ar ir"
).split()


def italian(word: str) -> str:
    vowels = "aeiouàèìòù"
    word = _marked_vowels(word.translate(str.maketrans("áéíóú", "àèìòù")), vowels, "ui", after_q=True)
    w = Regions(word, vowels, _rv(word, vowels))
    pronoun = w.ending(IT_PRONOUNS, w.rv)
    if pronoun:
        stem = _drop(w.word, pronoun)
        verb = _longest(stem, ["ando", "endo", "ar", "er", "ir"], w.rv)
        if verb:
            w.word = stem + ("e" if len(verb) == 2 else "")
    if not _iberian_suffix(w, IT_KINDS, IT_SWAPS, IT_IC, [], ["os", "ic", "abil"]):
        w.cut(w.ending(IT_VERBS, w.rv), w.rv)
    found = w.ending(list("aeioàèìò"), w.rv)
    if found:
        w.cut(found, w.rv)
        w.cut("i", w.rv)
    found = w.ending(["ch", "gh"], w.rv)
    if found:
        w.word = w.word[:-1]
    return w.word.lower()


#: The endings of the Portuguese stemmer; a~ and o~ stand for the nasal vowels.
PT_KINDS = {
    "delete": (
        "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es "
        "ante antes ância"
    ).split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "ity": ["idade", "idades"],
    "ive": "iva ivo ivas ivos".split(),
}
PT_SWAPS = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em "
    "arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es "
    "ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis "
    "ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos "
    "imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(word: str) -> str:
    vowels = "aeiouáéíóúâêô"
    word = word.replace("ã", "a~").replace("õ", "o~")
    w = Regions(word, vowels, _rv(word, vowels))
    altered = _iberian_suffix(w, PT_KINDS, PT_SWAPS, [], ["ante", "avel", "ível"], ["os", "ic", "ad"])
    found = w.ending(["ira", "iras"])
    if not altered and found and w.before(found) == "e":
        altered = w.cut(found, w.rv, "ir")
    if not altered:
        altered = w.cut(w.ending(PT_VERBS, w.rv), w.rv) if w.ending(PT_VERBS, w.rv) else False
    if altered:
        if w.word.endswith("ci") and len(w.word) - 1 >= w.rv:
            w.word = w.word[:-1]
    else:
        w.cut(w.ending("os a i o á í ó".split(), w.rv), w.rv)
    found = w.ending(["e", "é", "ê"], w.rv)
    if found:
        w.cut(found, w.rv)
        if w.word.endswith(("gu", "ci")) and len(w.word) - 1 >= w.rv:
            w.word = w.word[:-1]
    elif w.word.endswith("ç"):
        w.word = w.word[:-1] + "c"
    return w.word.replace("a~", "ã").replace("o~", "õ")


def dutch(word: str) -> str:
    vowels = "aeiouyè"
    word = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    word = "".join(
        c.upper() if c == "y" and (i == 0 or word[i - 1] in vowels) or c == "i" and i and word[i - 1] in vowels and word[i + 1 : i + 2] and word[i + 1] in vowels else c
        for i, c in enumerate(word)
    )
    w = Regions(word, vowels)
    w.r1 = max(w.r1, 3)

    def undouble() -> None:
        if w.word.endswith(("kk", "dd", "tt")):
            w.word = w.word[:-1]

    def en_ending(suffix: str) -> None:
        stem = _drop(w.word, suffix)
        if w.within(suffix, w.r1) and stem and stem[-1] not in vowels and not stem.endswith("gem"):
            w.word = stem
            undouble()

    def e_ending() -> bool:
        if w.word.endswith("e") and w.within("e", w.r1) and w.before("e") and w.before("e") not in vowels:
            w.word = w.word[:-1]
            undouble()
            return True
        return False

    found = w.ending(["heden", "en", "ene", "s", "se"])
    if found == "heden":
        w.cut(found, w.r1, "heid")
    elif found in ("en", "ene"):
        en_ending(found)
    elif found and w.before(found) and w.before(found) not in vowels + "j":
        w.cut(found, w.r1)
    removed_e = e_ending()
    if w.word.endswith("heid") and w.within("heid", w.r2) and w.before("heid") != "c":
        w.cut("heid", w.r2)
        if w.word.endswith("en"):
            en_ending("en")
    found = w.ending(["end", "ing", "ig", "lijk", "baar", "bar"])
    if found in ("end", "ing"):
        if w.cut(found, w.r2):
            if w.word.endswith("ig") and w.within("ig", w.r2) and w.before("ig") != "e":
                w.word = w.word[:-2]
            else:
                undouble()
    elif found == "ig":
        if w.before("ig") != "e":
            w.cut("ig", w.r2)
    elif found == "lijk":
        if w.cut("lijk", w.r2):
            e_ending()
    elif found == "baar" or found == "bar" and removed_e:
        w.cut(found, w.r2)
    end = w.word[-4:]
    if len(end) == 4 and end[0] not in vowels and end[1] == end[2] and end[1] in "aeou" and end[3] not in vowels + "I":
        w.word = w.word[:-2] + end[3]
    return w.word.lower()


def finnish(word: str) -> str:
    vowels, short = "aeiouyäö", "aeiouäö"
    long = [v * 2 for v in short]
    w = Regions(word, vowels)
    found = w.ending("kin kaan kään ko kö han hän pa pä sti".split(), w.r1)
    if found == "sti":
        w.cut(found, w.r2)
    elif found and w.before(found) and w.before(found) in vowels + "nt":
        w.cut(found, w.r1)

    found = w.ending("si ni nsa nsä mme nne an än en".split(), w.r1)
    stem = _drop(w.word, found)
    if found == "si":
        w.word = stem if not stem.endswith("k") else w.word
    elif found == "ni":
        w.word = stem[:-1] + "i" if stem.endswith("kse") else stem
    elif found in ("an", "än", "en"):
        before = {"an": "ta ssa sta lla lta na", "än": "tä ssä stä llä ltä nä", "en": "lle ine"}[found].split()
        w.word = stem if _longest(stem, before, w.r1) else w.word
    elif found:
        w.word = stem

    plain = "ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine".split()
    found = w.ending([*plain, *(f"h{v}n" for v in short), "siin", "den", "tten", "seen", "a", "ä", "tta", "ttä", "n"], w.r1)
    stem = _drop(w.word, found)
    case = False
    if found in plain and found:
        case = True
    elif found[:1] == "h":
        case = stem.endswith(found[1])
    elif found in ("siin", "den", "tten"):
        case = len(stem) > 1 and stem[-1] == "i" and stem[-2] in short
    elif found == "seen":
        case = stem[-2:] in long
    elif found in ("a", "ä"):
        case = len(stem) > 1 and stem[-1] in vowels and stem[-2] not in vowels
    elif found in ("tta", "ttä"):
        case = stem.endswith("e")
    elif found == "n":
        case = True
        if stem[-2:] in [*long, "ie"] and len(stem) - 1 >= w.r1:
            stem = stem[:-1]
    if case:
        w.word = stem

    found = w.ending("mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä".split(), w.r2)
    if found and (found[0] != "m" or not _drop(w.word, found).endswith("po")):
        w.cut(found, w.r2)
    if case:
        w.cut("i", w.r1) or w.cut("j", w.r1)
    elif w.word.endswith("t") and w.within("t", w.r1) and w.before("t") and w.before("t") in vowels:
        w.word = w.word[:-1]
        found = w.ending(["mma", "imma"], w.r2)
        if found and (found == "imma" or not _drop(w.word, found).endswith("po")):
            w.cut(found, w.r2)

    tail = w.word[w.r1 :]
    if tail[-2:] in long:
        w.word, tail = w.word[:-1], tail[:-1]
    if len(tail) > 1 and tail[-1] in "aäei" and tail[-2] not in vowels:
        w.word, tail = w.word[:-1], tail[:-1]
    if tail.endswith(("oj", "uj")):
        w.word, tail = w.word[:-1], tail[:-1]
    if tail.endswith("jo"):
        w.word = w.word[:-1]
    at = len(w.word)
    while at and w.word[at - 1] in vowels:
        at -= 1
    if at > 1 and w.word[at - 1] == w.word[at - 2]:
        w.word = w.word[: at - 1] + w.word[at:]
    return w.word


STEMMERS = {
    "danish": danish,
    "dutch": dutch,
    "english": porter,
    "finnish": finnish,
    "french": french,
    "german": german,
    "italian": italian,
    "norwegian": norwegian,
    "portuguese": portuguese,
    "russian": russian,
    "spanish": spanish,
    "swedish": swedish,
}
