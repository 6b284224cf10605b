"""Personal information in free text: found behind disguises, replaced by typed placeholders, the rest unchanged.

Method: transducers rewrite a text step by step into a plain form (JSON escapes, full-width and look-alike characters,
invisible characters, encoded or spelled ``at`` and ``dot``, spelled digits) and keep for every character of the result the
source characters it came from. Identifiers are recognised in the plain form, in a fixed order, each hiding its span from
the next; their spans are mapped back, so only source characters that belong to an identifier are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Set

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtrace.llm import given_names

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

# Look-alike letters (Cyrillic and Greek to Latin), invisible characters, dashes.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικ", "aeopcyxijsdhqwABEKMHOPCTYXIJSABEZHIKMNOPTYXoavik"))
INVISIBLE = "​‌‍⁠﻿­"
DASHES = "‐‑‒–—―−﹘﹣－"
# Digits as words.
DIGIT_WORDS = {
    **dict.fromkeys(("zero", "oh", "null", "zéro", "cero"), "0"),
    **dict.fromkeys(("one", "eins", "un", "uno"), "1"),
    **dict.fromkeys(("two", "zwei", "zwo", "deux", "dos"), "2"),
    **dict.fromkeys(("three", "drei", "trois", "tres"), "3"),
    **dict.fromkeys(("four", "vier", "quatre", "cuatro"), "4"),
    **dict.fromkeys(("five", "fünf", "cinq", "cinco"), "5"),
    **dict.fromkeys(("six", "sechs", "seis"), "6"),
    **dict.fromkeys(("seven", "sieben", "sept", "siete"), "7"),
    **dict.fromkeys(("eight", "acht", "huit", "ocho"), "8"),
    **dict.fromkeys(("nine", "neun", "neuf", "nueve"), "9"),
}
# Given names, the common ones by language and some rarer ones.
GIVEN = given_names.COMMON | frozenset(
    "Aaron Adam Adrian Aiko Alan Alberto Alejandro Alex Alexander Alice Amelia Amir Ana Andrea Andreas Andrew Angela Anita Anna Anne Anouk Antoine "
    "Antonio Arthur Astrid Barbara Beatriz Benjamin Bernard Bruno Camille Carla Carlos Carmen Caroline Catherine Charles Charlotte Chloé Christian "
    "Christine Claire Clara Claudia Clémence Daniel Dario David Diana Diego Dirk Edward Elena Elias Elisa Elizabeth Emeka Emil Emily Emma Eric Erik Eva "
    "Fabien Fatima Felix Fernando Francisco François Frank Friedrich Gabriel Georg George Gerhard Greta Hamza Hannah Hans Harry Heinrich Helen "
    "Helga Henry Hugo Ilse Ines Inés Ingrid Íñigo Isabel Jack Jacques James Jan Jane Jarek Javier Jean Jennifer Jens Jonas Jorge José Jörg Juan "
    "Julia Julie Jürgen Karl Katharina Klaus Kofi Lars Laura Lena Leonie Linda Lorcan Louis Louise Lucas Lucía Luis Manuel Marc Maria María "
    "Marie Marla Martin Mary Mateo Max Michael Milan Miguel Mohammed Monika Nadia Nicolas Noor Odette Olivia Oskar Pablo Paloma Patricia Paul Pedro "
    "Peter Petra Pierre Piet Priya Quentin Rachel Ravi Richard Robert Rosa Samuel Sarah Sebastian Sofia Sophie Stefan Stellan Sunniva Susan Sven Tamsin "
    "Thea Thomas Ulrich Vera Victor Wanda Werner William Wolfgang Xavier Yara Yuki Zeno".split()
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Mme", "Mlle", "Madame", "Monsieur", "Sr", "Sra", "Srta", "Señor", "Señora", "Don", "Doña", "Sir", "Lady")
# Words that follow a name-like word in names of organisations, projects and machines, or open a sentence.
NOT_SURNAMES = frozenset(
    "Systems System GmbH AG SA SL Ltd Inc LLC Corp Corporation Group Labs Lab Works Software Services Project Wiki Ledger Policy Team Server Bank "
    "Street Road Avenue Lane Hours Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September "
    "October November December The This That These Those There Then They And Or But If In On At To For From With When Where What Which Who Why How "
    "You We It Its Is Are Was Please Set Read Each Here Nobody Yesterday Compare Der Die Das Den Dem Ein Eine Einen Wenn Warum Wir Ich Er Sie Es Und "
    "Oder Aber Zur Zum Im Am Auf Niemand Gestern Lies Le La Les Un Une Des Du Et Ou Mais Si Pour Pourquoi Nous Vous Il Elle Hier Personne El Los Las "
    "Una Y O Pero Por Para Hemos Ayer Nadie Antes Se Hello Hi Dear Thanks Hallo Danke Bonjour Merci Hola Gracias Yes No Ok Draft Ask Move Since Fill Write Ship Pickup Call Send Can Could Did Done Reach Missed Bounce Build Route Window "
    "Hey Sorry Sure Okay Morning Evening Cheers Regards Welcome Congratulations Bye Now Today Tomorrow Tonight Actually However Also Meanwhile Finally Maybe Perhaps Regarding Because After Before While Since Until Does Has Have Had "
    "Will Would Should My Your Our His Her Their She He They Not Add Check Create Delete Fix Forward Get Give Keep Let Look Make Meet Open Remind Remove Reply Review Run See Start Stop Submit Take Tell Test Try Update Use "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonnabend Sonntag Januar Februar März Juni Juli Oktober Dezember Heute Morgen Bitte Hat Ist Kann Soll Sind Mein Meine Dein Unser Was Wer Wie Wann Weil Nach Vor Mit Von Bei Ihr "
    "Liebe Lieber Moin Servus Guten Salut Coucou Cher Chère Bonsoir Demain Quand Comment Avec Dans Sur Mon Mes Notre Votre Buenos Buenas Querido Querida Estimado Estimada Mañana Cuando Cómo Qué Quién Ella Nosotros Script "
    "Adapter Agent Cache Client Cluster Container Daemon Database Gateway Index Kafka Kernel Kubernetes Linux Loader Optimizer Pipeline Planner Platform Postgres Proxy Queue Redis Router Runner Scheduler Shell Spark Tracker Worker".split()
)

Span = tuple[int, int, str]


class Plain:
    """A rewritten text; character k came from the source characters ``first[k]:after[k]``."""

    __slots__ = ("after", "first", "spelled", "text")

    def __init__(self, text: str):
        self.text, self.first, self.after = text, None, None
        #: Source spans of numbers spelled digit by digit.
        self.spelled: list[tuple[int, int]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans (sorted, apart); all characters of a replacement come from its whole span."""
        if not edits:
            return
        first = self.first if self.first is not None else list(range(len(self.text)))
        after = self.after if self.after is not None else list(range(1, len(self.text) + 1))
        text, f, a, at = [], [], [], 0
        for i, j, new in edits:
            text += [self.text[at:i], new]
            f += first[at:i] + [first[i]] * len(new)
            a += after[at:i] + [after[j - 1]] * len(new)
            at = j
        self.text = "".join([*text, self.text[at:]])
        self.first, self.after = f + first[at:], a + after[at:]

    def source(self, i: int, j: int) -> tuple[int, int]:
        return (i, j) if self.first is None else (self.first[i], self.after[j - 1])


_ESCAPE = regex.compile(r'\\(?:u(?:d[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}|[0-9a-f]{4})|["\\/bfnrt])', regex.I)
_PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
_AT = regex.compile(r"%40|&#0*64;|&#x0*40;|&commat;|\s?[(\[{<]\s?(?:at|arroba|arobase|klammeraffe|ät)\s?[)\]}>]\s?|(?<=[\w.+-]) @ (?=[\w-]+\.)", regex.I)
_DOT = regex.compile(r"&#0*46;|&period;|\s?[(\[{<]\s?(?:dot|punkt|punto|point)\s?[)\]}>]\s?", regex.I)
_SPELLED = regex.compile(
    r"(?<![\w@])[\w.+-]+(?: (?:dot|punto|punkt|point|underscore|dash|hyphen|minus) [\w.+-]+){0,6}( at | arroba | arobase )[\w-]+(?: (?:dot|punto|punkt|point|dash|hyphen|minus) [\w-]+)+(?!\w)(?! (?:at|arroba|arobase) )", regex.I
)
_SPELLED_SIGN = regex.compile(r" (?:(dot|punto|punkt|point)|(underscore)|(?:dash|hyphen|minus)) ", regex.I)
_SPELLED_DIGITS = regex.compile(r"(?<!\w)(?:(?:%s)[ ,.-]{1,2}){6,}(?:%s)(?!\w)" % (("|".join(DIGIT_WORDS),) * 2), regex.I)
_ONE_DIGIT = regex.compile(r"\w+")


def _characters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        if c in INVISIBLE:
            edits.append((i, i + 1, ""))
        elif c in DASHES:
            edits.append((i, i + 1, "-"))
        elif c in LOOKALIKES:
            edits.append((i, i + 1, LOOKALIKES[c]))
        elif unicodedata.category(c) == "Zs":
            edits.append((i, i + 1, " "))
        else:
            folded = unicodedata.normalize("NFKC", c)
            # Signs such as the ordinal º are kept: addresses use them.
            if folded != c and c not in "ºª°":
                edits.append((i, i + 1, folded))
    return edits


def plain(content: str) -> Plain:
    """The plain form of a message's content, which is text or the JSON text of a list of blocks."""
    p = Plain(content)
    if "\\" in content and content.lstrip()[:1] == "[" and _is_blocks(content):
        p.rewrite([(m.start(), m.end(), json.loads(f'"{m.group()}"')) for m in _ESCAPE.finditer(content)])
    if not p.text.isascii():
        p.rewrite(_characters(p.text))
    # Most texts hold nothing of a disguise: one look for its signs spares the patterns.
    if _SIGNS.search(p.text):
        p.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(p.text)])
        p.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(p.text)])
    low = p.text.lower()
    edits: list[tuple[int, int, str]] = []
    for m in _SPELLED.finditer(p.text) if any(w in low for w in _ATS) and any(w in low for w in _DOTS) else ():
        signs = [(d.start(), d.end(), "." if d.group(1) else "_" if d.group(2) else "-") for d in _SPELLED_SIGN.finditer(p.text, *m.span(), overlapped=True)]
        edits += sorted([(*m.span(1), "@"), *signs])
    p.rewrite(edits)
    edits = []
    for m in _SPELLED_DIGITS.finditer(p.text) if _spells_digits(p.text.lower()) else ():
        upto = m.start()
        p.spelled.append(p.source(*m.span()))
        for d in _ONE_DIGIT.finditer(p.text, *m.span()):
            edits.append((upto, d.end(), DIGIT_WORDS[d.group().lower()]))  # the gap before it goes with it
            upto = d.end()
    p.rewrite(edits)
    return p


_SIGNS = re.compile(r"[%&(\[{<@]")
_ATS, _DOTS = (" at ", " arroba ", " arobase "), (" dot ", " punto ", " punkt ", " point ")
_is_digit_word = DIGIT_WORDS.__contains__


def _spells_digits(low: str) -> bool:
    return sum(map(_is_digit_word, low.replace(",", " ").replace("-", " ").replace(".", " ").split())) >= 7


def _is_blocks(content: str) -> bool:
    try:
        blocks = json.loads(content)
    except ValueError:
        return False
    return isinstance(blocks, list) and all(isinstance(b, dict) for b in blocks)


_UP = r"\p{Lu}[\p{L}'’-]+"
_DOMAIN = r"(?:[\p{L}\d][\p{L}\d-]{0,62}\.){1,8}\p{L}{2,24}(?![\w@-])"
# A remote such as git@host:path is no mailbox, nor is a package with its version (its last part is a number).
_EMAIL = regex.compile(rf"(?<![\w.+%@/-])(?!git@)[\w.+%'-]{{1,64}}@{_DOMAIN}|(?<=[=:?&<])(?!git@)[\w.+'-]{{1,64}}@{_DOMAIN}")
_ID = regex.compile(
    r"""(?x)(?<![\w-])(?:
      (?:(?:DNI|NIF)[ :#]*)?(?:\d{8}|\d{2}\.\d{3}\.\d{3})[ -]?[A-HJ-NP-TV-Z](?![\w-])(?:\ ?\((?:DNI|NIF)\))?
    | (?:NIE[ :#]*)?[XYZ][ -]?\d{7}[ -]?[A-Z](?![\w-])
    | (?:(?i:ssn|social\ security(?:\ (?:number|no\.?))?|soc\.?\ ?sec\.?(?:\ no\.?)?)[ :#]*)\d{3}[ -]?\d{2}[ -]?\d{4}(?![\w-])
    | \d{3}-\d{2}-\d{4}(?![\w-])
    | (?:(?i:steuer-?id(?:entifikationsnummer)?|steuernummer|idnr\.?|tax\ id)[ :#.]*)\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}(?![\w-])
    | (?:(?i:n[°ºo]\.?\ ?(?:de\ )?s[ée]cu(?:rit[ée]\ sociale)?|num[ée]ro\ de\ s[ée]curit[ée]\ sociale|nir|insee)[ :#]*)[12][ ]?\d{2}[ ]?\d{2}[ ]?(?:\d{2}|2[AB])[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})?(?![\w-])
    | [12]\ \d{2}\ \d{2}\ (?:\d{2}|2[AB])\ \d{3}\ \d{3}(?:\ \d{2})?(?![\w-])
    | (?:(?i:ni\ (?:number|no\.?)|nino|national\ insurance(?:\ (?:number|no\.?))?)[ :#]*)[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z](?!\w)
    | [A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D](?!\w)
    | (?:(?i:passport|passeport|pasaporte|reisepass(?:nummer)?|pass-?nr\.?)(?:\ (?i:no\.?|number|nr\.?|n[°º]))?[ :#]*)(?=[A-Z\d]*\d{4})[A-Z\d]{7,10}(?!\w)
    | (?:(?i:personalausweis(?:nummer)?|ausweis(?:nr\.?|nummer)?|identity\ card|id\ card|carte\ d'identit[ée]|cni)(?:\ (?i:no\.?|number|nr\.?|n[°º]))?[ :#]*)(?=[A-Z\d]*\d{2})[A-Z\d]{8,12}(?!\w)
    | (?:(?i:bsn|pesel|cpf|ahv(?:-?nr\.?)?|svnr\.?|sozialversicherungsnummer|rentenversicherungsnummer|versichertennummer|itin|sin|cpr|codice\ fiscale)(?:\ (?i:no\.?|number|nr\.?|n[°º]))?[ :#]*)(?=[A-Z\d. -]*\d{2})[A-Z\d](?:[ .-]?[A-Z\d]){5,15}(?!\w)
    | (?:(?i:driv(?:ing|er'?s?)\ licen[cs]e|f[üu]hrerschein(?:nr\.?|nummer)?|permis\ de\ conduire|permiso\ de\ conducir)(?:\ (?i:no\.?|number|nr\.?|n[°º]))?[ :#]*)(?=[A-Z\d]*\d{3})[A-Z\d]{8,18}(?!\w)
    )"""
)
_PHONE = regex.compile(
    r"""(?x)(?<![\w.:/@%+-])(?:tel:)?(?:
      (?:\+|00)(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])\d[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .\/-]?\d){4,11}
    | (?:\+|00)(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .\/-]?\d){6,11}
    | \+\d{8,14}
    | \(\d{3}\)[ .-]?[2-9]\d{2}[ .-]?\d{4}
    | 1?[ .-]?[2-9]\d{2}([ .-])[2-9]\d{2}\1\d{4}
    | 1[2-9]\d{2}[2-9]\d{6}
    | 0[1-9](?:([ .-])\d{2}(?:\2\d{2}){3}|\d{8})
    | 07\d{3}[ -]?\d{3}[ -]?\d{3}
    | \(?0\d{2,4}\)?[ ]?[\/-][ ]?\d{4,8}(?:-\d{1,4})?
    | 0\d{2,4}\ \d{5,8}
    | [6-9]\d{2}([ .-])\d{2}\3\d{2}\3\d{2}
    )(?:\ ?(?:ext\.?|x|ext|Durchwahl|poste)\ ?\d{1,5})?(?![\w]|[.:-]\d)"""
)
_ADDRESS = regex.compile(
    r"""(?x)(?<![\w\/])(?:
      (?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\ \d{1,4}[A-Z]?,\ )?\d{1,5}[A-Za-z]?\ (?:\p{Lu}[\p{L}'-]*\ ){1,3}
        (?:Street|St\.|St|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Court|Ct\.?|Terrace|Boulevard|Blvd\.?|Drive|Way|Place|Square|Crescent|Gardens|Grove|Row|Hill|Mews|Parade)(?!\w)
        (?:,\ (?:Apt\.?|Flat|Unit|Suite)\ \d{1,4}[A-Z]?)?(?:,\ \p{Lu}[\p{L}-]+(?:\ [A-Z]{1,2}\d{1,2}[A-Z]?\ \d[A-Z]{2})?)?
    | \d{1,5}(?:\ ?(?:bis|ter|quater))?,?\ (?:rue|avenue|all[ée]e|chemin|boulevard|place|impasse|quai|route|cours|square|passage|ruelle)\ (?:(?:de\ la|de\ l'|des|du|de|d'|la|le|les)\ ?)?\p{Lu}[\p{L}'-]*(?:[\ -](?:(?:de|du|des|la)\ )?\p{Lu}[\p{L}'-]*)*(?:,\ \d{5}\ \p{Lu}[\p{L}-]+)?
    | \p{Lu}[\p{Ll}]*(?:-\p{Lu}\p{Ll}+)*(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig|pfad|markt)\ \d{1,4}(?:\ ?[a-z](?!\w))?(?:,\ \d{5}\ \p{Lu}[\p{L}-]+)?
    | (?:\p{Lu}\p{Ll}+(?:er|-\p{Lu}\p{Ll}+)?\ )(?:Stra(?:ß|ss)e|Str\.|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer)\ \d{1,4}(?:\ ?[a-z](?!\w))?(?:,\ \d{5}\ \p{Lu}[\p{L}-]+)?
    | (?:Calle|C\/|C\.|Avda\.?|Av\.|Avenida|Paseo|P\.º|Plaza|Pza\.?|Camino|Ronda|Traves[íi]a|Carretera)\ ?(?:(?:de\ las|de\ los|de\ la|del|de|las|los|la|el|Las|Los|La|El)\ )?\p{Lu}[\p{L}'-]*(?:\ (?:(?:de\ la|del|de)\ )?\p{Lu}[\p{L}'-]*)*,?\ (?:n\.?º\ ?)?\d{1,4}(?:,\ \d{1,2}[ºª°](?:\ [A-Z](?!\w))?)?(?:,\ \d{5}\ \p{Lu}[\p{L}-]+)?
    | (?:Via|Viale|Vicolo|Piazza|Piazzale|Corso|Rua|Praça|Travessa|Largo|ul\.|ulica|aleja)\ (?:(?:della|delle|dei|del|di|da|das|dos|do)\ )?\p{Lu}[\p{L}'-]*(?:\ (?:(?:della|del|di|da|dos|do|e)\ )?\p{Lu}[\p{L}'-]*)*,?\ (?:n\.?º?\ ?)?\d{1,4}(?!\w)
    )"""
)
_PARTICLE = r"(?:(?:van|von|de|del|der|den|di|da|la|le|zu|zum|ten|y|d'|O')(?:\ (?:der|den|la|las|los|le))?\ )?"
_TITLED = regex.compile(rf"(?<![\w-])(?:(?:(?:{'|'.join(TITLES)})\.? ){{1,3}}|M\. )(?:\p{{Lu}}\. ?){{0,2}}{_PARTICLE}({_UP})(?: (?:\p{{Lu}}\. )*{_PARTICLE}({_UP}))?")
_FULL = regex.compile(rf"(?<![\w@.-])(\p{{Lu}}[\p{{L}}]+)(?:-(\p{{Lu}}[\p{{L}}]+))?(?: \p{{Lu}}\.)* {_PARTICLE}({_UP})(?![\w@])")
_INITIAL = regex.compile(rf"(?<![\w.§º°&-])(?<!z\. )(?:\p{{Lu}}\.[ -]?){{1,3}} ?{_PARTICLE}({_UP})(?![\w@])")
_CAPITALS = regex.compile(r"(?<![\w@.-])(\p{Lu}{3,}(?:-\p{Lu}{3,})?) (\p{Lu}\p{Ll}+)(?:-\p{Lu}\p{Ll}+)?(?![\w@-])")
_TURNED = regex.compile(rf"(?<![\w@.-])(?:(?:van|von) )?({_UP})(?:, |;)(\p{{Lu}}\p{{Ll}}+)(?:-\p{{Lu}}\p{{Ll}}+)?(?: \p{{Lu}}\.)?(?![\w@-])")
_CUED = regex.compile(
    rf"(?i:my name is|mein name ist|ich hei(?:ß|ss)e|je m'appelle|me llamo|mi nombre es|signed,|gezeichnet|\bname: ?|\"(?:customer|name|contact|author|owner)\": ?\")\ ?({_UP} (?:\p{{Lu}}\. )*{_PARTICLE}{_UP})"
)

#: Parts of the words of ``_CUED``.
_CUES = ("name", "ich hei", "appelle", "me llamo", "nombre", "signed,", "gezeichnet", '"customer"', '"contact"', '"author"', '"owner"')

_PAIR = regex.compile(rf"(?<![\w@.'’-])(\p{{Lu}}\p{{Ll}}[\p{{L}}'’]*)(?:-(\p{{Lu}}\p{{Ll}}+))? (?:\p{{Lu}}\. )?(?:(?:van|von|der|den|di|da|dos|ten|bin|al) ){{0,2}}(\p{{Lu}}[\p{{L}}'’]*\p{{Ll}})(?:-\p{{Lu}}\p{{Ll}}+)?(?![\w@'’-])")
# Words that tell German text, where every noun is capital, and what stands right before a person's name in any.
_GERMAN = re.compile(r"(?i)\b(?:der|die|das|und|ist|nicht|ein|eine|mit|für|auf|den|dem|wir|ich|zur|zum|von|wenn|bitte)\b")
_BEFORE_NAME = regex.compile(
    r"(?i)(?:^|[\s,.:;!?(\"“«])(?:dear|hi|hello|hey|hallo|liebe|lieber|guten (?:tag|morgen|abend)|cher|chère|bonjour|salut|estimad[oa]|querid[oa]|hola|thanks|thank you|regards|best|cheers|gr(?:u|ü)(?:ß|ss)e?n?|danke|"
    r"cordialement|saludos|atentamente|attn:?|cc:?|from:?|contact:?|ask|call|tell|told|met|meet|invite|kontakt:?|ansprechpartner(?:in)?:?|sagt|sagte|schrieb|fragte|fragt|ruft|bittet|von|bei|mit|an|für),?[ \n]$"
)


def _unlisted_names(text: str, lexicon: Set[str]) -> Iterator[tuple[int, int]]:
    """Two capital words that are no common words: names by their shape where capitals are rare, else by the word before."""
    german: bool | None = None
    for m in _PAIR.finditer(text, overlapped=True):
        first, second, last = m.groups()
        common = [w for w in (first, second, last) if w and (w in NOT_SURNAMES or w.lower() in lexicon)]
        at = m.start()
        if common or text[max(0, at - 2) : at].startswith("\x01"):  # after an address stands its town
            continue
        if german is None:
            german = len(_GERMAN.findall(text)) > 1
        if not german or _BEFORE_NAME.search(text, max(0, at - 24), at):
            yield m.span()


def _names(text: str, lexicon: Set[str] = frozenset()) -> Iterator[tuple[int, int]]:
    listed = list(_listed_names(text))
    yield from listed
    if lexicon:
        # Where a name is known already, its neighbours are none of it.
        yield from (x for x in _unlisted_names(text, lexicon) if not any(i < x[1] and x[0] < j for i, j in listed))


def _listed_names(text: str) -> Iterator[tuple[int, int]]:
    for m in _TITLED.finditer(text):
        if m.group(1) not in NOT_SURNAMES:
            full = m.group(2) and m.group(1).split("-")[0] in GIVEN and m.group(2) not in NOT_SURNAMES
            yield m.start(), m.end() if full else m.end(1)
    for m in _FULL.finditer(text, overlapped=True):
        if (m.group(1) in GIVEN or (m.group(2) and m.group(2) in GIVEN)) and m.group(3) not in NOT_SURNAMES:
            yield m.span()
    for m in _INITIAL.finditer(text):
        if m.group(1) not in NOT_SURNAMES:
            yield m.span()
    for m in _CAPITALS.finditer(text):
        if m.group(2) in GIVEN:
            yield m.span()
    for m in _TURNED.finditer(text):
        if m.group(2) in GIVEN and m.group(1) not in NOT_SURNAMES and m.group(1).split("-")[0] not in GIVEN:
            yield m.span()
    low = text.lower()
    for m in _CUED.finditer(text) if any(w in low for w in _CUES) else ():
        if m.group(1).split()[-1] not in NOT_SURNAMES:
            yield m.span(1)


def spans(content: str, lexicon: Set[str] = frozenset()) -> list[Span]:
    """``(start, end, type)`` of the personal information in ``content``, as source positions, sorted and apart.

    ``lexicon`` holds common words in lower case; with it names are found that no list knows.
    """
    p = plain(content)
    text, found = p.text, []

    def take(kind: str, places: list[tuple[int, int]]) -> None:
        nonlocal text
        joined: list[list[int]] = []
        for i, j in sorted(places):
            if joined and i < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], j)
            else:
                joined.append([i, j])
        for i, j in joined:
            found.append((*p.source(i, j), kind))
            text = text[:i] + "\x01" * (j - i) + text[j:]

    if "@" in text:
        take("email", [m.span() for m in _EMAIL.finditer(text)])
    n_digits = len(_DIGIT.findall(text))
    low = text.lower() if 0 < n_digits < 6 else ""
    if n_digits >= 6 or any(cue in low for cue in _ID_CUES):  # without a cue, no number of a person has fewer digits
        take("id_number", [m.span() for m in _ID.finditer(text)])
    if n_digits:
        take("street_address", [m.span() for m in _ADDRESS.finditer(text)])
    if n_digits >= 6:
        take("phone", [m.span() for m in _PHONE.finditer(text)])
    taken = {i for i, _, _ in found}
    # A number that somebody spells digit by digit, and that is no other identifier, is one to call.
    found += [(i, j, "phone") for i, j in p.spelled if not any(i <= k < j for k in taken)]
    take("person_name", list(_names(text, lexicon)))
    return sorted(found)


_DIGIT = re.compile(r"\d")
#: Parts of words that name a personal number; the patterns of such numbers ask for two digits only.
_ID_CUES = ("pass", "ausweis", "identi", "id card", "cni", "bsn", "pesel", "cpf", "ahv", "svnr", "itin", "sin ", "sin:", "sin#", "cpr", "versicher", "codice", "licen", "schein", "permi")


def redact(content: str, found: list[Span] | None = None) -> str:
    """``content`` with each identifier replaced by ``[TYPE]``."""
    out, at = [], 0
    for i, j, kind in spans(content) if found is None else found:
        if i >= at:
            out += [content[at:i], _PLACEHOLDER[kind]]
            at = j
    return "".join([*out, content[at:]])


def read_lexicon(path: str) -> frozenset[str]:
    """The lower-case words that a public byte-level vocabulary has as one token: its common words, a set of fixed size."""
    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    return frozenset(w[1:] for w in words if w[0] == "Ġ" and w[1:].isalpha() and w[1:].islower())


def find_and_replace(messages: DataFrame, key: str = "payload_id", text: str = "content", lexicon_path: str | None = None) -> DataFrame:
    """``key, text, pii_types``: every row's text with placeholders, and the types that occur (sorted, each once).

    A null text stays null with an empty list, as does a text without personal information with its own text. Rows, also
    repeated ones, come out one for one; other columns are not read. Works in each row's own task, on whole texts. With
    ``lexicon_path`` (a public vocabulary) names are found that no list knows.
    """
    fields = [messages.schema[key], T.StructField(text, T.StringType()), T.StructField("pii_types", T.ArrayType(T.StringType()))]
    # About 20,000 words whatever the data: broadcast once.
    words = messages.sparkSession.sparkContext.broadcast(read_lexicon(lexicon_path) if lexicon_path else frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for value in batch.column(1).to_pylist():
                found = spans(value, words.value) if value else []
                texts.append(redact(value, found) if found else value)
                kinds.append(sorted({k for _, _, k in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], [f.name for f in fields])

    return messages.select(key, text).mapInArrow(run, T.StructType(fields))
