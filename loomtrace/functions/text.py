"""Text functions as column expressions (in the JVM); Arrow-batched Python only where no built-in expresses the semantics."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Credential patterns and keys whose values are never shown.
SECRET_PATTERNS = {
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+",
    "sk_key": r"\bsk-[A-Za-z0-9_-]{16,}\b",
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
}
SECRET_KEYS = ("apikey", "authorization", "clientsecret", "cookie", "password", "privatekey", "refreshtoken", "secret", "setcookie", "token", "accesstoken")
REDACTED = "[REDACTED]"
# Intents in order, the words that show them.
INTENTS = (
    ("forget", ("forget", "delete from memory", "remove from memory", "tombstone", "忘记", "遗忘", "删除记忆")),
    ("memory_write", ("remember", "save to memory", "write to memory", "记住", "保存到记忆", "写入记忆")),
    ("trace_query", ("trace", "traces", "run history", "运行轨迹", "轨迹", "审计记录")),
    ("history_query", ("history", "previous conversation", "what did we discuss", "历史", "之前聊过", "上次")),
    ("skill_discovery", ("skill", "skills", "how can you", "能力", "技能", "有没有工具")),
    ("review", ("review", "evaluate", "regression", "复盘", "评审", "评估", "回归")),
)
# Failure families in order, the words that show them.
FAILURES = (
    ("resource_not_found", ("file_not_found", "filenotfound", "file not found")),
    ("permission_denied", ("permission", "access_denied", "forbidden")),
    ("invalid_arguments", ("invalid_tool_arguments", "validationerror", "invalid argument")),
    ("timeout", ("timeout", "timed out")),
    ("rate_limited", ("rate_limit", "rate limit", "429")),
    ("policy_blocked", ("policy_blocked", "policyerror", "blocked")),
)
# The names of thinking tags, and of the marker of channels.
THINK_NAMES = ("think", "thinking", "thought")
CHANNEL_MARKS = ("<channel>", "<channel|>", "<|channel>", "<|channel|>")
#: A thinking tag: slash, name, and how it closes (nothing, if the name ends in what can't belong to a tag), or a channel mark.
_TAG = re.compile(rf"<(/?)({'|'.join(sorted(THINK_NAMES, key=len, reverse=True))})(/?>|(?![A-Za-z0-9_:>/-]))|{'|'.join(map(re.escape, CHANNEL_MARKS))}")


def squeeze(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, three or more line breaks two; the ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_html(text: Column) -> Column:
    """Text without scripts, styles and tags, entities decoded: the rare ones in Python, only where a text holds any."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<script.*?</script>", ""), r"(?is)<style.*?</style>", ""), r"<[^>]+>", "")
    decoded = F.when(bare.rlike(r"&#?\w"), decode_entities(bare)).otherwise(bare)
    return F.regexp_replace(decoded, r"^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Character references of HTML decoded, over Arrow batches (the table of names is Python's)."""
    return texts.map(lambda t: t if t is None else html.unescape(t))


class _Markdown(HTMLParser):
    """Writes Markdown while a page is read; elements whose text is needed as a whole have a buffer of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, list[str]]] = [("", "", [])]
        self.hidden = 0

    def _write(self, text: str) -> None:
        if not self.hidden:
            self.open[-1][2].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        href = dict(attrs).get("href")
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("br", "hr"):
            self._write("\n")
        elif tag == "li" or tag == "a" and href or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.open.append((tag, href or "", []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("p", "div", "section", "article"):
            self._write("\n\n")
        elif any(tag == name for name, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._end(False)
            self._end(True)

    def _end(self, closed: bool) -> None:
        tag, href, parts = self.open.pop()
        text = "".join(parts)
        if closed:
            text = text.strip()
            text = f"[{text}]({href})" if tag == "a" else f"\n- {text}" if tag == "li" else f"\n{'#' * int(tag[1])} {text}\n"
        self._write(text)

    def handle_data(self, data: str) -> None:
        self._write(data)

    def written(self) -> str:
        while len(self.open) > 1:
            self._end(False)
        return "".join(self.open[0][2])


def markdown(page: str | None) -> str | None:
    """An HTML page as Markdown: links, headings, list items, paragraphs and breaks; null stays null."""
    if page is None:
        return None
    writer = _Markdown()
    writer.feed(page)
    writer.close()
    lines = [" ".join(x for x in re.split(r"[ \t]+", line)) for line in writer.written().split("\n")]
    return re.sub(r"\n\n\n+", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def to_markdown(pages: pd.Series) -> pd.Series:
    """:func:`markdown` over Arrow batches (a page is read by a parser)."""
    return pages.map(markdown)


def redact(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Credentials replaced, and what further patterns match."""
    for pattern in (*SECRET_PATTERNS.values(), *more):
        text = F.regexp_replace(text, pattern, REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return text


def redaction_counts(text: Column) -> list[Column]:
    """One count for every credential pattern."""
    return [F.regexp_count(text, F.lit(p)).alias(f"n_{name}") for name, p in SECRET_PATTERNS.items()]


def normalize_key(key: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def redact_map(values: Column, more_keys: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> Column:
    """A map with the values of secret keys (and of ``more_keys``) replaced and credentials (and ``more``) replaced in the others."""
    secret = {*SECRET_KEYS, *(re.sub("[^a-z0-9]", "", k.lower()) for k in more_keys)}
    return F.transform_values(values, lambda k, v: F.when(normalize_key(k).isin(*sorted(secret)), F.lit(REDACTED)).otherwise(redact(v, more)))


def visible(text: str | None) -> str | None:
    """Text without thinking, in one pass over its tags; null stays null.

    A closed block goes wherever it stands; one that never closes goes with the rest if nothing stands before it; a tag that
    breaks off goes. Single closing tags, empty ``<thinking/>`` and channel marks go at the edges only, since elsewhere somebody
    talks about them. At the very end the beginning of such a tag goes too (a stream may stop there).
    """
    if text is None:
        return None
    pieces: list[tuple[str, bool]] = []  # text, and whether it is a mark that goes at an edge

    def shown() -> bool:
        return any(t.strip() for t, mark in pieces if not mark)

    at = 0
    while found := _TAG.search(text, at):
        slash, name, tail = found.groups()
        pieces.append((text[at : found.start()], False))
        at = found.end()
        if name is None:
            pieces.append((found.group(), not shown()))
        elif tail == ">" and not slash:
            end = text.find(f"</{name}>", at)
            if end >= 0:
                at = end + len(name) + 3
            elif not shown():
                at = len(text)
            else:
                pieces.append((found.group(), False))
        elif tail or slash:
            pieces.append((found.group(), tail == ">" or name == "thinking" and not slash))
    pieces.append((text[at:], False))
    first = next((k for k, (t, mark) in enumerate(pieces) if t.strip() and not mark), len(pieces))
    last = next((k for k in range(len(pieces) - 1, -1, -1) if pieces[k][0].strip() and not pieces[k][1]), -1)
    out = "".join(t for k, (t, mark) in enumerate(pieces) if not (mark and (k < first or k > last)))
    return out[: len(out) - _partial(out)].strip()


def _partial(text: str) -> int:
    """Length of the beginning of a tag at the end of a text (a bare ``<`` only if it is all of it)."""
    at = text.rfind("<")
    tail = text[at:] if at >= 0 else ""
    whole = [f"<{slash}{n}>" for n in THINK_NAMES for slash in ("", "/")] + list(CHANNEL_MARKS)
    bare = tail.strip("</|") == ""
    return len(tail) if tail and any(w.startswith(tail) for w in whole) and (not bare or text.strip() == tail) else 0


@F.pandas_udf(T.StringType())
def strip_think(texts: pd.Series) -> pd.Series:
    """:func:`visible` over Arrow batches (what a tag means depends on the tags before it)."""
    return texts.map(visible)


def truncate(text: Column, limit: int, suffix: str = "\n... (truncated)") -> Column:
    """At most ``limit`` code points, then the suffix; shorter texts and limits below 1 change nothing."""
    return F.when((F.length(text) > limit) & F.lit(limit > 0), F.concat(F.substring(text, 1, max(limit, 0)), F.lit(suffix))).otherwise(text)


def truncate_bytes(text: Column, limit: int, suffix: str = "\n... (truncated)") -> Column:
    """At most ``limit`` bytes of UTF-8, whole code points, the suffix included if it fits; limits below 1 change nothing."""
    room = limit - len(suffix.encode())
    # A code point cut in two becomes the replacement character at the end.
    head = lambda n: F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")), "\ufffd+$", "")
    cut = F.concat(head(room), F.lit(suffix)) if room > 0 else head(limit)
    return F.when((F.octet_length(text) > limit) & F.lit(limit > 0), cut).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Tokens of a message by its UTF-8 bytes: bytes + 4, at least 4."""
    return F.greatest(F.lit(4), F.coalesce(F.octet_length(text), F.lit(0)) + 4)


def split_text(text: str, limit: int) -> list[str]:
    """Chunks of at most ``limit`` characters, cut at a line break if there is one, else a blank, else hard."""
    if not text:
        return []
    out = []
    while limit > 0 and len(text) > limit:
        at = next((p for p in (text.rfind("\n", 0, limit), text.rfind(" ", 0, limit)) if p > 0), limit)
        out.append(text[:at])
        text = text[at:].lstrip()
    return [*out, text] if text else out


def chunks(text: Column, limit: int) -> Column:
    """:func:`split_text` as an array column over Arrow batches; null and empty texts have no chunk."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit) if t else [])

    return cut(text)


def _shows(text: Column, word: str) -> Column:
    if any("一" <= c <= "鿿" for c in word):
        return F.contains(text, F.lit(word))
    return text.rlike(rf"(?<![a-z0-9_])\Q{word}\E(?![a-z0-9_])")


def intent(text: Column) -> Column:
    """The first intent whose words the text shows (whole words; substrings for Chinese), else ``task``."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F
    for name, words in INTENTS:
        any_word = _shows(low, words[0])
        for w in words[1:]:
            any_word = any_word | _shows(low, w)
        out = out.when(any_word, F.lit(name))
    return out.otherwise(F.lit("task"))


def failure_family(detail: Column, stop_reason: Column) -> Column:
    """The first family whose words the detail shows, else by the stop reason."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    out = F
    for name, words in FAILURES:
        any_word = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            any_word = any_word | F.contains(low, F.lit(w))
        out = out.when(any_word, F.lit(name))
    return out.when(stop_reason == "tool_error", "tool_exception").when(stop_reason == "error", "agent_exception").otherwise("unknown_failure")


def mask_names(text: Column) -> Column:
    """File names and dates or long numbers masked, blanks squeezed, lower case: equal goals look equal."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\w./-]+\.[A-Za-z0-9]{1,8}\b", "<file>")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(named, r"\d{4}-\d{2}-\d{2}|\d{4,}", "<id>"), r"\s+", " ")))


def backoff(at: Column, attempt: Column) -> Column:
    """The time of the next try: 2^(attempt - 1) minutes later."""
    return F.timestamp_micros(F.unix_micros(at) + F.pow(F.lit(2), attempt - 1).cast("bigint") * 60_000_000)


def next_due(kind: Column, anchor: Column, every_s: Column, after: Column) -> Column:
    """When a job runs next after ``after``: ``at`` its anchor if that is still to come, ``every`` the next whole period from its anchor.

    Null where it never does (a past ``at``, a period below a second, another kind; for cron see ``edits.next_run``).
    """
    start, now = F.unix_micros(anchor), F.unix_micros(after)
    period = F.when(every_s >= 1, every_s * F.lit(1_000_000).cast("bigint"))
    later = F.when(start > now, start).otherwise(start + (F.floor((now - start) / period) + 1) * period)
    return F.when((kind == "at") & (start > now), anchor).when(kind == "every", F.timestamp_micros(later.cast("bigint")))


def near_paths(path: Column) -> Column:
    """The path with one directory left out, for every directory: keys that find a mistyped path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.array_join(F.filter(parts, lambda x, k: k != i), "/"))


def glob_pattern(pattern: str) -> str:
    """A glob as a regular expression: ``**`` over directories, ``*`` and ``?`` within one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"
