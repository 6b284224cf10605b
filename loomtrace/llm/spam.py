"""Keyword-stuffed pages, link lists and lists of tags or products: pages that are such text for more than half.

Method: a text is cut into phrases at separators. Thresholds on missing function words (per language), on separator-bound lists,
on links without describing text, on the share of the top word and n-grams in a sentence and in the page, on separator
density and on duplicate lines tell for every phrase whether it is ordinary; the page is told by the characters of the others. Code, tables of options, logs and
described links are ordinary by these rules, not by exceptions for pages. The thresholds of the page's shares are calibrated
per language, on the shares of all pages that the other signals take as ordinary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.session import written

# Words without which no sentence of the language goes on for long; prepositions that stand within
# noun phrases (de, of names) are left out where a list of phrases could hold them.
FUNCTION_WORDS = {
    "en": frozenset(
        "the a an and or to of in is it for that this with on as at by be are was were not you your which what when so if but have has had do does we "
        "he she they from how why who can will would its there than then our my me his her their them us because before after until without".split()
    ),
    "fr": frozenset(
        "le la les et un une des qui dans pour est sur ne il elle au aux ce cette ces se sa son ses nous vous on où avec par plus sont était étaient qu "
        "que avons a ont été lui leur mais ou c'est".split()
    ),
    "de": frozenset(
        "der die das und ist ein eine einen einem einer den dem zu nicht mit sich auf für im am an von er es sie wir ich war als auch nur wenn was wie "
        "dass bei nach vor ohne über wird hat haben man aus in ihn heißt bleibt solange".split()
    ),
    "es": frozenset(
        "el los las la y e en por con lo como su sus al es son se ha cuando si porque pero sin sobre qué este esta mi tu nos ya hemos está estaba una "
        "un no que queda mientras".split()
    ),
}
# Characters that carry the grammar of Chinese sentences (without 在线, online); Japanese kana do the same.
GRAMMAR = re.compile(r"在(?!线)|如果|因为|为什么|为了|[的了是我们就没请这那都把被但让将ぁ-ゟ]")
# Look-alike letters and characters that are not seen.
_PLAIN = {ord(a): b for a, b in zip("аеорсухіјѕԁһԛԝ", "aeopcyxijsdhqw")} | dict.fromkeys(map(ord, "​‌‍⁠﻿­"), None)

# Further words that carry no content, for shares of single words.
LINKING = frozenset("de del des les par para pour sans avec après comme como cada und oder von vom zum zur für per than into any all each".split())

# The same for scripts that the languages above do not use (Russian, Ukrainian, Greek, Arabic).
OTHER_FUNCTION = frozenset(
    "и в не на что я он она они мы вы с как это по но из у за то же так для от о бы если когда чтобы который которая которые без или уже его её их і та що як це до від не є "
    "και το η ο οι τα να που με σε για από δεν είναι στο στη την τον του της θα αν όταν في من على إلى عن أن إن لا ما هذا هذه التي الذي كان هو هي مع أو ثم".split()
)

#: Items in a row that make a list on any page.
LIST_ITEMS = 8
#: Shorter runs are lists too on a page with so many items, if together they are more than ``CASE_SHARE`` of its characters.
PAGE_ITEMS = 3
#: Words of an item in a script without function words here (as Hangul); longer phrases are sentences.
OTHER_WORDS = 3
#: Share of a sentence's words that n-grams must cover which it repeats, or which a stuffed sentence beside it repeats.
TOP_SHARE = 0.35
#: A page's top word and top n-gram (two or three content words) must stand so often to count at all.
TOP_COUNT = 4
#: Least shares of all words, and least share of separators among separators and words, that can ever tell a page.
FLOORS = {"top_word": 0.12, "top_gram": 0.12, "separators": 0.25}
#: Thresholds of the three shares stand so far above the quantile ``QUANTILE`` of a language's ordinary pages.
MARGINS, QUANTILE = {"top_word": 1.5, "top_gram": 1.5, "separators": 1.15}, 0.999
#: The thresholds where no pages are known, and the number of pages in whose place they stand in every language.
PRIOR, PRIOR_PAGES = {"top_word": 0.15, "top_gram": 0.25, "separators": 0.3}, 1_000
#: A page is taken as ordinary for the calibration up to this share of other text, found without these thresholds.
ORDINARY = 0.1
#: In a language without a list here, sentences of so many words make a page prose from this share of its characters on.
SENTENCE_WORDS, PROSE_SHARE = 5, 0.5
#: Words without a function word that count as one item of a list, for lists without separators.
ITEM_WORDS = 6
#: The same for scripts without blanks, in characters.
ITEM_CHARS = 12
#: A language is taken for a text's own from so many different function words on.
LANGUAGE_WORDS = 2
#: A line of at least so many words that stands so often is a duplicate.
LINE_WORDS, LINE_COUNT = 4, 4
#: Share of the characters of a page that make it a case.
CASE_SHARE = 0.5

_LINK = r"\[/?url\b[^\]\n]*\]|(?:https?://|www\.)[^\s<>\])\"']+"
#: Links without a scheme: only looked for in texts with a slash, since every word is a possible start.
_BARE_LINK = r"|(?<![\w.-])[\w-]{1,63}\.[\w.-]+/[^\s<>\])\"']*"


#: What stands between phrases starts with one of these; most characters are passed by at the first look.
_STARTS = r"[`\[hw<.!?。！？\n;|,~•·>()\]{}:/\\»«=*#\"“”—–，；：、｜（）［］｛｝【】「」『』《》〈〉／＼～＃＊＝・ ]"


def _pattern(others: str = "") -> re.Pattern[str]:
    return re.compile(
        rf"((?={_STARTS})(?:"
        r"```.*?(?:```|\Z)"  # fenced code
        r"|`[^`\n]*`"  # code in a line
        rf"|{_LINK}"
        r"|<\|\w{1,40}\|>|</?\w[^<>]{0,300}>"  # special tokens, tags
        r"|[.!?]+(?=[\s<\"”»]|$)|[。！？]|\n+"  # ends of sentences
        r"|[;|,~•·<>()\[\]{}:/\\»«=*#\"“”—–，；：、?!｜（）［］｛｝【】「」『』《》〈〉／＼～＃＊＝・]+| [-+] "  # separators
        rf"){others})",
        re.S,
    )


_CUT, _CUT_PROSE = _pattern(_BARE_LINK), _pattern()
_DISGUISED = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
#: Letters without a Latin look-alike: where these are common, the text is in that script and disguises nothing.
_CYRILLIC = re.compile("[бгджзийлптфцчшщъыьэюя]")
_LATIN = re.compile(r"[a-z]")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u2fff\uac00-\ud7ff]")
_CJK, _HANGUL = re.compile("[ぁ-ヿ㐀-鿿豈-﫿𠀀-𲎯]"), re.compile("[가-힣]")
_MARK = re.compile("[\u0300-\u036f]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_WORD = re.compile(r"\W+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")

CODE, LINK, END, BREAK, SENTENCE, PHRASE, BLANK, STUFFED = range(8)


def function_words(words: set[str]) -> frozenset[str]:
    """The function words of the language of which most different ones occur; none if there are very few of any."""
    best = max(FUNCTION_WORDS.values(), key=lambda own: len(own & words))
    return best if len(best & words) >= LANGUAGE_WORDS else frozenset()


def _kind(piece: str) -> int:
    c = piece[0]
    if c == "`":
        return CODE
    if c == "<":
        return LINK if "href" in piece else BREAK
    if c == "[" and len(piece) > 3:
        return LINK
    if c in ".!?。！？\n":
        return END
    return LINK if len(piece) > 4 and (c.isalnum() or c == "_") else BREAK


#: Separators met so far with their kind: at most the strings of three characters that the pattern can match and texts hold.
_separators: dict[str, tuple[int, int]] = {}


def _separator(piece: str) -> tuple[int, int]:
    """Kind and visible size of what stands between phrases; short ones are kept."""
    found = (_kind(piece), len(piece.strip()))
    if len(piece) < 4:
        _separators[piece] = found
    return found


def _is_cjk(text: str) -> bool:
    """Whether Chinese characters or kana stand in it, whatever signs stand beside them."""
    return not text.isascii() and bool(_CJK.search(text)) and not _HANGUL.search(text)


def _is_prose(text: str) -> bool:
    """Whether most of a text are sentences by their form: a capital, some words, a full stop."""
    share = 0
    for part in _SENTENCES.split(text):
        part = part.strip()
        if part and part[0].isupper() and part[-1] in ".!?" and part.count(" ") >= SENTENCE_WORDS - 1:
            share += len(part)
    return share >= PROSE_SHARE * len(text)


def _phrase_kind(text: str, ws: list[str], function: frozenset[str]) -> int:
    if not ws:
        return BLANK
    if not text.isascii():
        if _is_cjk(text):
            return SENTENCE if GRAMMAR.search(text) else PHRASE
        if _OTHER_SCRIPT.search(text) and not _LATIN.search(text):
            if not any(map(str.isalpha, text)):
                return BLANK
            return PHRASE if len(ws) <= OTHER_WORDS and OTHER_FUNCTION.isdisjoint(ws) and any(map(str.isalpha, ws)) else SENTENCE
    return (PHRASE if function.isdisjoint(ws) else SENTENCE) if text.islower() else BLANK


def _grams(words: list[str] | str, function: frozenset[str]) -> list[tuple[int, object]]:
    """(position, n-gram): pairs of content words, or four characters of a script without blanks."""
    if isinstance(words, str):
        return [(i, words[i : i + 4]) for i in range(len(words) - 3)]
    return [(i, pair) for i, pair in enumerate(zip(words, words[1:])) if pair[0] not in function and pair[1] not in function]


def _is_content(word: str, function: frozenset[str]) -> bool:
    return len(word) > 2 and word not in function and word not in LINKING and word.isalpha()


def _characters(phrase: str, size: int) -> list[str]:
    """n-grams of a script without blanks that hold no grammar."""
    return [part[i : i + size] for part in GRAMMAR.split(phrase) for i in range(len(part) - size + 1)]


def _top_word(phrases: list[list[str] | str], size: int, function: frozenset[str]) -> set[object]:
    """The word (of a script without blanks, pair of characters) that a sentence repeats most, if it alone covers much of it."""
    counts = Counter(chain.from_iterable([w for w in phrases if isinstance(w, list)]))
    out: set[object] = set()
    if counts and max(counts.values()) >= TOP_SHARE * size:
        out = {(w,) for w, n in counts.items() if n > 1 and n >= TOP_SHARE * size and _is_content(w, function)}
    pairs = Counter(g for w in phrases if isinstance(w, str) for g in _characters(w, 2))
    return out | {g for g, n in pairs.items() if n > 1 and 2 * n >= TOP_SHARE * size}


_times = itemgetter(1)


def _page_tops(phrases: list[list[str] | str], function: frozenset[str]) -> tuple[float, float, set[object], set[object]]:
    """Shares of all words that the page's top word and its top n-gram cover, and the words and n-grams over the least shares."""
    lists, strings = [w for w in phrases if isinstance(w, list)], [w for w in phrases if isinstance(w, str)]
    # Two characters of a script without blanks count as a word.
    total = max(sum(map(len, lists)) + sum(map(len, strings)) / 2, 1)
    words = Counter(chain.from_iterable(lists))
    counts: dict[object, int] = {}
    least = FLOORS["top_word"] * total
    for w, n in sorted([x for x in words.items() if x[1] > 1], key=_times, reverse=True):
        if counts and n < least:
            break
        if _is_content(w, function):
            counts[(w,)] = n
    if strings:
        counts |= Counter(g for w in strings for g in _characters(w, 2))
    most, gram = max(counts.values(), default=1), 0.0
    tops = {g for g, n in counts.items() if n >= TOP_COUNT and n >= least}
    of_grams: set[object] = set()
    for size in (2, 3):
        # No n-gram stands more often than its words.
        if most < TOP_COUNT or size * most < FLOORS["top_gram"] * total:
            continue
        runs = Counter(chain.from_iterable([zip(*(w[i:] for i in range(size))) for w in lists]))
        grams: dict[object, int] = {g: n for g, n in runs.items() if n > 1 and function.isdisjoint(g) and LINKING.isdisjoint(g)}
        if strings:
            grams |= Counter(g for w in strings for g in _characters(w, 2 * size))
        n = max(grams.values(), default=0)
        gram = max(gram, size * n / total if n >= TOP_COUNT else 0)
        of_grams |= {g for g, n in grams.items() if n >= TOP_COUNT and n * size >= FLOORS["top_gram"] * total}
    return min(most / total, 1.0) if most >= TOP_COUNT else 0.0, min(gram, 1.0), tops, of_grams


def _holds(words: list[str] | str, tops: set[object]) -> bool:
    if isinstance(words, str):
        return any(isinstance(g, str) and g in words for g in tops)
    return any(isinstance(g, tuple) and any(tuple(words[i : i + len(g)]) == g for i in range(len(words) - len(g) + 1)) for g in tops)


def _covered(places: list[tuple[int, int, object]], grams: set[object], size: int) -> bool:
    covered = {(k, i + d) for k, i, g in places if g in grams for d in range(len(g))}
    return len(covered) >= TOP_SHARE * size


def _repeats(phrases: list[list[str] | str], size: int, function: frozenset[str]) -> bool:
    """Whether a sentence repeats enough for n-grams to cover ``TOP_SHARE`` of it: half of that must be words that stand before."""
    words = phrases[0] if len(phrases) == 1 else list(chain.from_iterable(phrases))
    few = (1 - TOP_SHARE / 2) * size
    if len(set(words)) > few:
        return False
    content = [w for w in words if w not in function]
    return len(content) - len(set(content)) >= TOP_SHARE / 2 * size


def _stuffed(sentences: list[list[list[str] | str]], function: frozenset[str]) -> list[bool]:
    """For each sentence (its phrases) whether n-grams that it or a stuffed neighbour repeats cover much of it."""
    places: list[list[tuple[int, int, object]]] = []
    own: list[set[object]] = []
    single = False
    sizes = [sum(map(len, phrases)) for phrases in sentences]
    # Repeated n-grams that cover so much leave a sentence few different words: most sentences need no closer look.
    close = [size > 1 and _repeats(phrases, size, function) for phrases, size in zip(sentences, sizes)]
    if not any(close):
        return close
    beside = [close[i] or any(close[max(0, i - 1) : i + 2]) for i in range(len(close))]
    for phrases, size, look in zip(sentences, sizes, beside):
        found = [(k, i, g) for k, words in enumerate(phrases) for i, g in _grams(words, function)] if look else []
        twice = {g for g, n in Counter(g for _, _, g in found).items() if n > 1} if len(found) > 1 else set()
        twice = twice if twice and _covered(found, twice, size) else set()
        top = _top_word(phrases, size, function) if look else set()
        places.append(found)
        own.append(twice | top)
        single |= bool(top)
    if single:
        for phrases, found, look in zip(sentences, places, beside):
            for k, words in enumerate(phrases if look else ()):
                found += [(k, i, words[i : i + 2]) for i in range(len(words) - 1)] if isinstance(words, str) else [(k, i, (w,)) for i, w in enumerate(words)]
    out = []
    for i, (found, size) in enumerate(zip(places, sizes)):
        near = own[i] or (own[i - 1] if i else set()) | (own[i + 1] if i + 1 < len(own) else set())
        out.append(bool(near) and (bool(own[i]) or _covered(found, near, size)))
    return out


def _by_kind(marks: list[int], sizes: list[int], described: set[int]) -> list[int]:
    """Visible characters of each kind; markup counts with what stands before it."""
    share = [0] * 8
    last = BLANK
    for i, k in enumerate(marks):
        if not sizes[i]:
            continue
        if k == LINK and i in described:
            k = SENTENCE
        elif k == END or k == BREAK:
            k = last
        share[k] += sizes[i]
        last = k
    return share


def _lists_prevail(marks: list[int], sizes: list[int], described: set[int], total: int) -> bool:
    """Whether the page's phrases and undescribed links are more than half of it, in runs of any length."""
    if sum([k == PHRASE or k == LINK and i not in described for i, k in enumerate(marks)]) < PAGE_ITEMS:
        return False
    share = _by_kind(marks, sizes, described)
    return share[PHRASE] + share[LINK] > CASE_SHARE * total


_NO_WORDS: list[str] = []
SHARES = ("n_chars", "list_share", "link_share", "stuffed_share", "duplicate_share", "spam_share", "top_word_share", "top_gram_share", "separator_density")
_BLANK_PAGE: tuple[str, list[float], list[float]] = ("", [0.0] * 5, [0.0] * 12)


def analyse(text: str | None) -> tuple[str, list[float], list[float]]:
    """A page's language, its features that need no threshold of the language, and its shares by what the thresholds may say.

    The features are visible characters, share of duplicate lines, shares of the page's top word and top n-gram (of all words;
    0 if they stand fewer than ``TOP_COUNT`` times), and separators by separators and words. The shares (of lists, links and stuffed
    text) come for four cases: neither tops nor separators pass, tops alone, separators alone, both.
    """
    if not text or text.isspace():
        return _BLANK_PAGE
    disguised = not text.isascii() and _DISGUISED.search(text) and len(_CYRILLIC.findall(text)) * 50 < len(text)
    plain = text.translate(_PLAIN) if disguised else text
    if not text.isascii() and _MARK.search(text) and len(_MARK.findall(text)) * 4 > len(text):
        plain = _MARK.sub("", unicodedata.normalize("NFD", plain))  # accents over everything hide the words
    plain = plain.lower().replace("'", " ").replace("’", " ")
    pieces = (_CUT if "/" in plain else _CUT_PROSE).split(plain)
    texts = pieces[::2]
    own_words: list[list[str] | str] = [t.split() for t in texts]
    function = function_words(set().union(*own_words))
    language = next((k for k, own in FUNCTION_WORDS.items() if own is function), "")
    if plain.isascii():
        apart = function.isdisjoint
        own_kinds = [(PHRASE if apart(ws) else SENTENCE) if ws and t.islower() else BLANK for t, ws in zip(texts, own_words)]
    else:
        own_kinds = [_phrase_kind(t, ws, function) for t, ws in zip(texts, own_words)]
        language = language or ("zh" if GRAMMAR.search(plain) else "")
        own_words = [_NOT_WORD.sub("", t) if _is_cjk(t) else ws for t, ws in zip(texts, own_words)]
    if not function and language != "zh" and PHRASE in own_kinds and _is_prose(text.translate(_PLAIN) if disguised else text):
        own_kinds = [SENTENCE if k == PHRASE else k for k in own_kinds]
    between = [_separators.get(p) or _separator(p) for p in pieces[1::2]]
    kinds, sizes, words = [BLANK] * len(pieces), [0] * len(pieces), [_NO_WORDS] * len(pieces)
    kinds[::2], kinds[1::2] = own_kinds, [k for k, _ in between]
    sizes[::2], sizes[1::2] = [len(t) - t.count(" ") for t in texts], [n for _, n in between]
    words[::2] = own_words
    total = sum(sizes)
    if not total:
        return _BLANK_PAGE

    # Links are described if a sentence stands between them and the link before or after.
    described: set[int] = set()
    links = [i for i, k in enumerate(kinds) if k == LINK]
    if links:
        upto, n = [0], 0
        for k, w in zip(kinds, words):
            n += k == SENTENCE and len(w) > 2
            upto.append(n)
        ends = [-1, *links, len(kinds)]
        for a, here, b in zip(ends, ends[1:], ends[2:]):
            if upto[b] > upto[a + 1]:
                described.add(here)

    n_words = sum(map(len, own_words)) - sum([len(w) / 2 for w in own_words if isinstance(w, str)] if not plain.isascii() else ())
    n_breaks = [k for k, _ in between].count(BREAK)
    density = n_breaks / max(n_breaks + n_words, 1)

    # Lists: many phrases or undescribed links with no sentence between; a long phrase counts as several.
    run: list[int] = []
    sentences: list[list[int]] = []
    sentence: list[int] = []
    beside: list[bool] = []  # for each sentence whether code or a described link stands in it
    described_here = False

    short: list[int] = []  # items of runs too short to be lists by themselves
    middling: list[int] = []  # items of runs that are long enough between dense separators

    def close() -> None:
        items = sum([1 + len(words[j]) // (ITEM_CHARS if isinstance(words[j], str) else ITEM_WORDS) for j in run])
        if items < LIST_ITEMS:
            (short if items < PAGE_ITEMS else middling).extend(run)
        run.clear()

    for i, k in enumerate(kinds):
        if k == SENTENCE:
            sentence.append(i)
            if run:
                close()
        elif k == PHRASE:
            sentence.append(i)
            run.append(i)
        elif k == END:
            if sentence:
                sentences.append(sentence)
                beside.append(described_here)
                sentence = []
            described_here = False
        elif k == LINK and i not in described:
            run.append(i)
        elif k == LINK or k == CODE:
            described_here = True
            if run:
                close()
    close()
    if sentence:
        sentences.append(sentence)
        beside.append(described_here)

    # Single letters are no items.
    items = [BLANK if k == PHRASE and isinstance(w, list) and len(max(w, key=len)) < 2 else k for k, w in zip(kinds, words)]
    # Clauses beside a sentence, and long phrases without blanks that happen to hold no grammar, are items in long runs only.
    clauses = {j for x in sentences if any(kinds[j] == SENTENCE for j in x) for j in x} if short or middling else set()

    def listed(loose: list[int]) -> list[int]:
        """The marks if the items ``loose`` stand in runs too short."""
        marks = list(items)
        for j in loose:
            if kinds[j] == PHRASE and (j in clauses or isinstance(words[j], str) and len(words[j]) > ITEM_CHARS):
                marks[j] = BLANK
        if loose and not _lists_prevail(marks, sizes, described, total):
            for j in loose:
                marks[j] = BLANK
        return marks

    # Stuffed sentences: repeated words or n-grams cover much of the sentence, or it holds one that covers much of the page.
    phrases = [[words[j] for j in x] for x in sentences]
    # Sentences that differ in digits at most count once for the page: what one template repeats is no search phrase.
    bare = _DIGITS.sub("", "\0".join(texts)).split("\0") if "\0" not in plain else texts
    distinct = {tuple([bare[j // 2] for j in x]): own for x, own, apart in zip(sentences, phrases, beside) if not apart}
    top_word, top_gram, tops, grams = _page_tops([w for x in distinct.values() for w in x], function)
    stuffed = [x for x, is_stuffed in zip(sentences, _stuffed(phrases, function)) if is_stuffed]
    topped = [x for x, own, apart in zip(sentences, phrases, beside) if not apart and any(_holds(w, tops | grams) for w in own)] if tops or grams else []

    def shares(marks: list[int], more: list[list[int]]) -> list[float]:
        for x in chain(stuffed, more):
            for j in x:
                marks[j] = STUFFED
        share = _by_kind(marks, sizes, described)
        return [share[PHRASE] / total, share[LINK] / total, share[STUFFED] / total]

    loose = short + middling
    neither = shares(listed(loose), [])
    with_tops = shares(listed(loose), topped) if topped else neither
    differs = middling and density >= FLOORS["separators"]
    between_separators = shares(listed(short), []) if differs else neither
    both = (shares(listed(short), topped) if topped else between_separators) if differs else with_tops

    # Duplicate lines outside of code.
    duplicate = 0
    lines = Counter(line.strip() for line in plain.split("\n") if len(line) > 12) if "\n" in plain else {}
    repeated = {line for line, n in lines.items() if n >= LINE_COUNT and line.count(" ") >= LINE_WORDS - 1}
    if repeated:
        fenced = {line.strip() for p in pieces[1::2] if p[:3] == "```" for line in p.split("\n")}
        for line in repeated:
            if line not in fenced:
                duplicate += (lines[line] - 1) * (len(line) - line.count(" "))
    return language, [float(total), duplicate / total, top_word, top_gram, density], neither + with_tops + between_separators + both


def features(text: str | None, thresholds: dict[str, float] = PRIOR) -> dict[str, float]:
    """The features :data:`SHARES` of a page, told by ``thresholds``: ``n_chars`` are visible characters.

    Shares are of the visible characters, those of the page's top word and n-gram of all words; ``separator_density`` is
    separators by separators and words; markup counts with what stands before it. Null, empty and blank texts: all 0.
    """
    _, (n_chars, twice, top_word, top_gram, density), shares = analyse(text)
    case = (top_word >= thresholds["top_word"] or top_gram >= thresholds["top_gram"]) + 2 * (density >= thresholds["separators"])
    listed, linked, stuffed = shares[3 * case : 3 * case + 3]
    # Duplicate lines may be lists or stuffed too: the larger of both counts.
    return dict(zip(SHARES, (n_chars, listed, linked, stuffed, twice, max(listed + linked + stuffed, twice), top_word, top_gram, density)))


def is_spam(f: dict[str, float]) -> bool:
    """Whether a page with these features is a case: more than half of it is no ordinary text."""
    return f["spam_share"] > CASE_SHARE


_ANALYSIS = ("n_chars", "duplicate_share", "top_word_share", "top_gram_share", "separator_density")


def analysed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, language``, the features of :func:`analyse` and ``shares`` of each row's whole text, in its own task."""
    fields = [docs.schema[key], T.StructField("language", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in _ANALYSIS], T.StructField("shares", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [analyse(v) for v in batch.column(1).to_pylist()]
            columns = [pa.array([r[1][k] for r in rows], pa.float64()) for k in range(len(_ANALYSIS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), *columns, pa.array([r[2] for r in rows], pa.list_(pa.float64()))], [f.name for f in fields])

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))


def calibrated(pages: DataFrame) -> DataFrame:
    """The thresholds of every language that occurs: ``language, top_word, top_gram, separators``, from all pages of :func:`analysed`.

    A language's ordinary pages are those that the thresholds don't touch and whose other shares are low; a threshold lies above
    nearly all of them (``QUANTILE``, ``MARGINS``), the less sure the fewer they are (``PRIOR_PAGES``).
    """
    other = F.greatest(F.aggregate(F.slice("shares", 1, 3), F.lit(0.0), lambda a, x: a + x), "duplicate_share")
    ordinary = pages.filter(F.col("n_chars") > 0).withColumn("ordinary", other <= ORDINARY)
    columns = {"top_word": "top_word_share", "top_gram": "top_gram_share", "separators": "separator_density"}
    own = {k: F.when(F.col("ordinary") & (F.col(c) > 0) & (F.col(c) < 1), F.col(c)) for k, c in columns.items()}
    known = ordinary.groupBy("language").agg(*[x for k, v in own.items() for x in (F.count(v).alias(f"n_{k}"), F.percentile_approx(v, QUANTILE, 10_000).alias(k))])
    weighed = lambda k: (F.coalesce(F.col(k) * MARGINS[k], F.lit(0.0)) * F.col(f"n_{k}") + PRIOR[k] * PRIOR_PAGES) / (F.col(f"n_{k}") + PRIOR_PAGES)
    return known.select("language", *[F.greatest(F.lit(FLOORS[k]), weighed(k)).alias(k) for k in columns])


def page_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the columns of :func:`features` and ``is_spam`` for each row, by the thresholds of its language.

    The texts are read once; the thresholds come from the features of all pages (:func:`calibrated`), a row for each of the few
    languages, hence the broadcast. Rows come out one for one, repeated ones too; other columns are not read; null and blank
    texts are no cases.
    """
    pages = written(analysed(docs, key, text))
    judged = pages.join(F.broadcast(calibrated(pages)), "language", "left")
    tops = (F.col("top_word_share") >= F.col("top_word")) | (F.col("top_gram_share") >= F.col("top_gram"))
    case = F.coalesce(tops.cast("int") + 2 * (F.col("separator_density") >= F.col("separators")).cast("int"), F.lit(0))
    share = lambda k: F.element_at("shares", 3 * case + k + 1)
    told = judged.select(key, "n_chars", share(0).alias("list_share"), share(1).alias("link_share"), share(2).alias("stuffed_share"), *_ANALYSIS[1:])
    spam = F.greatest(F.col("list_share") + F.col("link_share") + F.col("stuffed_share"), F.col("duplicate_share"))
    return told.withColumn("spam_share", spam).select(key, *SHARES, (spam > CASE_SHARE).alias("is_spam"))
