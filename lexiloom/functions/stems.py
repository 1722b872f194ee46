"""Stems of six languages by the published Snowball algorithms (https://snowballstem.org/algorithms, the definitions before version 3).

Suffixes are fixed values, listed as the published definitions list them. A region is where a suffix must begin to count: R1 begins after
the first consonant that follows a vowel, R2 likewise inside R1, RV by a rule of each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache


def _r1(w: str, vowels: str, start: int = 0) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
    return m.end() if m else len(w)


def _longest(w: str, suffixes: Iterable[str], start: int = 0) -> str:
    """The longest suffix of ``w`` that lies behind ``start``, or ''."""
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default="")


def _spread(table: dict[str, str]) -> dict[str, str]:
    """{'suffixes': 'what they become'} -> one entry a suffix."""
    return {s: b for a, b in table.items() for s in a.split()}


# -- English -----------------------------------------------------------------------------------------------------------------

_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_EN_AFTER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = _spread({
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer ization": "ize", "ational ation ator": "ate", "alism aliti alli": "al", "fulness fulli": "ful",
    "ousli ousness": "ous", "iveness iviti": "ive", "biliti bli": "ble", "lessli": "less", "ogi": "og", "li": "",
})
_EN_3 = _spread({"tional": "tion", "ational": "ate", "alize": "al", "icate iciti ical": "ic", "ful ness ative": ""})
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _en_short(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


def _english(w: str) -> str:
    if len(w) <= 2:
        return w
    w = w.replace("’", "'").removeprefix("'")
    if w in _EN_WHOLE or w in _EN_SAME:
        return _EN_WHOLE.get(w, w)
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = re.match("gener|commun|arsen", w)
    p1 = head.end() if head else _r1(w, "aeiouy")
    p2 = _r1(w, "aeiouy", p1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in _EN_AFTER:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= p1 else w
    elif s and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif p1 >= len(w) and _en_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _longest(w, _EN_2)
    if s and len(w) - len(s) >= p1:
        before = w[: -len(s)][-1:]
        if not (s == "ogi" and before != "l" or s == "li" and before not in tuple("cdeghkmnrt")):
            w = w[: -len(s)] + _EN_2[s]
    s = _longest(w, _EN_3)
    if s and len(w) - len(s) >= (p2 if s == "ative" else p1):
        w = w[: -len(s)] + _EN_3[s]
    s = _longest(w, _EN_4)
    if s and len(w) - len(s) >= p2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) > p2 or len(w) > p1 and not _en_short(w[:-1])) or w.endswith("ll") and len(w) > p2:
        w = w[:-1]
    return w.lower()


# -- German ------------------------------------------------------------------------------------------------------------------


def _german(w: str) -> str:
    v = "aeiouyäöü"
    w = re.sub(rf"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), w.replace("ß", "ss"))
    p1 = _r1(w, v)
    p2 = _r1(w, v, p1)
    p1 = max(p1, 3)
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= p1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= p1 and (s != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= p2:
        rest = w[: -len(s)]
        if s in ("end", "ung"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= p2 and not rest.endswith("eig") else rest
        elif s in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif s in ("lich", "heit"):
            w = rest[:-2] if rest.endswith(("er", "en")) and len(rest) - 2 >= p1 else rest
        else:
            t = _longest(rest, ("lich", "ig"))
            w = rest[: -len(t)] if t and len(rest) - len(t) >= p2 else rest
    return w.lower().translate(str.maketrans("äöü", "aou"))


# -- French ------------------------------------------------------------------------------------------------------------------

_FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_AT = "atrice ateur ation atrices ateurs ations".split()
_FR_1 = [*_FR_PLAIN, *_FR_AT, *"logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()]
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french(w: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = re.sub("(?<=q)u", "U", w)
    w = re.sub(rf"(?<=[{v}])[ui](?=[{v}])|(?<=[{v}])y|y(?=[{v}])", lambda m: m[0].upper(), w)
    w = w.replace("ë", "He").replace("ï", "Hi")
    if re.match(rf"[{v}][{v}].|par|col|tap", w):
        pv = 3
    else:
        m = re.compile(f"[{v}]").search(w, 1)
        pv = m.end() if m else len(w)
    p1 = _r1(w, v)
    p2 = _r1(w, v, p1)

    def drop(t: str, end: str, instead: str | None = None) -> str:
        """``t`` without ``end`` where it lies in R2; else, if given, with something in its place."""
        if len(t) - len(end) >= p2:
            return t[: -len(end)]
        return t if instead is None else t[: -len(end)] + instead

    began, adverb = w, False
    s = _longest(w, _FR_1)
    rest, at = w[: len(w) - len(s)], len(w) - len(s)
    if s in _FR_PLAIN:
        w = rest if at >= p2 else w
    elif s in _FR_AT:
        if at >= p2:
            w = drop(rest, "ic", "iqU") if rest.endswith("ic") else rest
    elif s in ("logie", "logies"):
        w = rest + "log" if at >= p2 else w
    elif s in ("usion", "ution", "usions", "utions"):
        w = rest + "u" if at >= p2 else w
    elif s in ("ence", "ences"):
        w = rest + "ent" if at >= p2 else w
    elif s in ("ement", "ements"):
        if at >= pv:
            w, end = rest, _longest(rest, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
            if end == "iv":
                w = drop(rest, end)
                if w != rest and w.endswith("at"):
                    w = drop(w, "at")
            elif end == "eus":
                w = drop(rest, end) if len(rest) - 3 >= p2 else rest[:-3] + "eux" if len(rest) - 3 >= p1 else rest
            elif end in ("abl", "iqU"):
                w = drop(rest, end)
            elif end and len(rest) - 3 >= pv:
                w = rest[:-3] + "i"
    elif s in ("ité", "ités"):
        if at >= p2:
            w, end = rest, _longest(rest, ("abil", "ic", "iv"))
            if end:
                w = drop(rest, end, {"abil": "abl", "ic": "iqU", "iv": None}[end])
    elif s in ("if", "ive", "ifs", "ives"):
        if at >= p2:
            w = rest
            if rest.endswith("at"):
                w = drop(rest, "at")
                if w != rest and w.endswith("ic"):
                    w = drop(w, "ic", "iqU")
    elif s == "eaux":
        w = rest + "eau"
    elif s == "aux":
        w = rest + "al" if at >= p1 else w
    elif s in ("euse", "euses"):
        w = rest if at >= p2 else rest + "eux" if at >= p1 else w
    elif s in ("issement", "issements"):
        w = rest if at >= p1 and rest and rest[-1] not in v else w
    elif s in ("amment", "emment"):
        w, adverb = (rest + s[0].replace("a", "ant").replace("e", "ent"), True) if at >= pv else (w, False)
    elif s:
        w, adverb = (rest, True) if at - 1 >= pv and rest[-1] in v else (w, False)
    if w == began or adverb:
        verb = w
        s = _longest(w, _FR_I, pv)
        if s and len(w) - len(s) - 1 >= pv and w[-len(s) - 1] not in v + "H":
            verb = w[: -len(s)]
        if verb == w:
            s = _longest(w, ["ions", *_FR_E, *_FR_A], pv)
            if s == "ions":
                verb = w[:-4] if len(w) - 4 >= p2 else w
            elif s:
                verb = w[: -len(s)]
                if s in _FR_A and verb.endswith("e") and len(verb) - 1 >= pv:
                    verb = verb[:-1]
        changed, w = adverb or verb != w, verb
    else:
        changed = True
    if changed:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and len(w) > 1 and (w[-2] not in "aiouès" or w.endswith("His")):
            w = w[:-1]
        s = _longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), pv)
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= p2 and len(w) - 4 >= pv and w[-4] in "st" else w
        elif s:
            w = w[: -len(s)] + ("" if s == "e" else "i")
    if re.search("(enn|onn|ett|ell|eill)$", w):
        w = w[:-1]
    w = re.sub(rf"[éè](?=[^{v}]+$)", "e", w)
    return w.replace("He", "ë").replace("Hi", "ï").lower()


# -- Spanish and Italian -------------------------------------------------------------------------------------------------------


def _rv_south(w: str, v: str) -> int:
    if len(w) < 2:
        return len(w)
    if w[1] not in v:
        m = re.compile(f"[{v}]").search(w, 2)
    elif w[0] in v:
        m = re.compile(f"[^{v}]").search(w, 2)
    else:
        return min(3, len(w))
    return m.end() if m else len(w)


_ES_PRONOUN = "me se sela selo selas selos la le lo las les los nos".split()
_ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_AD = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
_ES_1 = [*_ES_PLAIN, *_ES_AD, *"logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split()]
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_EN = "en es éis emos".split()
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _spanish(w: str) -> str:
    v = "aeiouáéíóúü"
    pv, p1 = _rv_south(w, v), _r1(w, v)
    p2 = _r1(w, v, p1)
    s = _longest(w, _ES_PRONOUN)
    if s:
        rest = w[: -len(s)]
        t = _longest(rest, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if t and len(rest) - len(t) >= pv and (t != "yendo" or rest.endswith("uyendo")):
            w = rest[: -len(t)] + t.translate(_ACUTE)
    began = w
    s = _longest(w, _ES_1)
    rest, at = w[: len(w) - len(s)], len(w) - len(s)
    then: tuple[str, ...] = ()
    if s in ("logía", "logías"):
        w = rest + "log" if at >= p2 else w
    elif s in ("ución", "uciones"):
        w = rest + "u" if at >= p2 else w
    elif s in ("encia", "encias"):
        w = rest + "ente" if at >= p2 else w
    elif s and at >= (p1 if s == "amente" else p2):
        w = rest
        then = {"amente": ("iv", "os", "ic", "ad"), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(s, ("at",) if s[:2] == "iv" else ("ic",) if s in _ES_AD else ())
        t = _longest(w, then)
        if t and len(w) - len(t) >= p2:
            w = w[: -len(t)]
            if s == "amente" and t == "iv" and w.endswith("at") and len(w) - 2 >= p2:
                w = w[:-2]
    if w == began:
        s = _longest(w, _ES_Y, pv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w, [*_ES_EN, *_ES_VERB], pv)
            if s:
                w = w[: -len(s)]
                if s in _ES_EN and w.endswith("gu"):
                    w = w[:-1]
    s = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and len(w) - len(s) >= pv:
        w = w[: -len(s)]
        if s in "eé" and w.endswith("gu") and len(w) - 1 >= pv:
            w = w[:-1]
    return w.translate(_ACUTE)


_IT_PRONOUN = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
).split()
_IT_PLAIN = (
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
).split()
_IT_AT = "azione azioni atore atori".split()
_IT_1 = [*_IT_PLAIN, *_IT_AT, *"logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive".split()]
_IT_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò "
    "erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti "
    "ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def _italian(w: str) -> str:
    v = "aeiouàèìòù"
    w = re.sub("(?<=q)u", "U", w.translate(str.maketrans("áéíóú", "àèìòù")))
    w = re.sub(rf"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), w)
    pv, p1 = _rv_south(w, v), _r1(w, v)
    p2 = _r1(w, v, p1)
    s = _longest(w, _IT_PRONOUN)
    if s:
        rest = w[: -len(s)]
        t = _longest(rest, ("ando", "endo", "ar", "er", "ir"))
        if t and len(rest) - len(t) >= pv:
            w = rest + ("" if len(t) == 4 else "e")
    began = w
    s = _longest(w, _IT_1)
    rest, at = w[: len(w) - len(s)], len(w) - len(s)
    if s in ("logia", "logie"):
        w = rest + "log" if at >= p2 else w
    elif s in ("uzione", "uzioni", "usione", "usioni"):
        w = rest + "u" if at >= p2 else w
    elif s in ("enza", "enze"):
        w = rest + "ente" if at >= p2 else w
    elif s and at >= (pv if s[1:] in ("mento", "menti") else p1 if s == "amente" else p2):
        w = rest
        then = {"amente": ("iv", "os", "ic", "abil"), "ità": ("abil", "ic", "iv")}.get(s, ("at",) if s[:2] == "iv" else ("ic",) if s in _IT_AT else ())
        t = _longest(w, then)
        if t and len(w) - len(t) >= p2:
            w = w[: -len(t)]
            more = "at" if s == "amente" and t == "iv" else "ic" if t == "at" else ""
            if more and w.endswith(more) and len(w) - 2 >= p2:
                w = w[:-2]
    if w == began:
        s = _longest(w, _IT_VERB, pv)
        w = w[: len(w) - len(s)]
    if w[-1:] and w[-1] in "aeioàèìò" and len(w) - 1 >= pv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= pv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= pv:
        w = w[:-1]
    return w.lower()


# -- Russian -------------------------------------------------------------------------------------------------------------------

_RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _russian(w: str) -> str:
    v = "аеиоуыэюя"
    w = w.replace("ё", "е")
    m = re.search(f"[{v}]", w)
    pv = m.end() if m else len(w)
    p2 = _r1(w, v, _r1(w, v))

    def without(t: str, groups: tuple[list[str], list[str]]) -> str:
        """Without the longest ending; those of the first group need а or я before them."""
        s = _longest(t, [*groups[0], *groups[1]], pv)
        if not s or s not in groups[1] and not (len(t) - len(s) > pv and t[-len(s) - 1] in "ая"):
            return t
        return t[: -len(s)]

    t = without(w, _RU_GERUND)
    if t == w:
        w = w[: len(w) - len(_longest(w, ("ся", "сь"), pv))]
        s = _longest(w, _RU_ADJECTIVE, pv)
        if s:
            t = without(w[: -len(s)], _RU_PARTICIPLE)
        else:
            t = without(w, _RU_VERB)
            if t == w:
                t = w[: len(w) - len(_longest(w, _RU_NOUN, pv))]
    w = t[:-1] if t.endswith("и") and len(t) > pv else t
    s = _longest(w, ("ост", "ость"), max(p2, pv))
    w = w[: len(w) - len(s)]
    s = _longest(w, ("ейш", "ейше", "нн", "ь"), pv)
    if s in ("ейш", "ейше"):
        w = w[: -len(s)]
        w = w[:-1] if w.endswith("нн") and len(w) - 2 >= pv else w
    elif s:
        w = w[:-1]
    return w


_STEMMERS = {"en": _english, "de": _german, "fr": _french, "es": _spanish, "it": _italian, "ru": _russian}


@lru_cache(maxsize=200_000)
def snowball(word: str, lang: str) -> str:
    """The stem of a lower-case word."""
    return _STEMMERS[lang](word)
