"""How a text ends: its closing token in its place of the line, what it left open, and the use of all tokens in the corpus.

Nothing here decides anything. Every line of every text counts its tokens by the place they stand in, and the tokens at which lines, lists and
paragraphs really end; a text's closing token is described in the same terms, and truncation.py compares how often such a place is passed with how
often something ends there. What a text opened (header block, part, html, encoded data) are tokens too, counted by texts.
"""

from __future__ import annotations

import re
from collections import Counter

# Characters that end a sentence, and those that may follow them.
FINAL, AFTER = ".!?。！？", "\"'”’»)]*_"
# Places of a token: after a sentence's end, in a line that goes on from the line above, beyond the sixth word, in a table's row, in a list's
# item, at a line's start, in a line of Japanese, in such a list's item. The first three are prose.
PLACES, PROSE = "swltbhji", "swl"
#: A line of at least so many characters (of Japanese: JAPANESE_WRAP) that more text follows is wrapped, unless its last sign ends a sentence.
WRAP, JAPANESE_WRAP, FEW_WORDS = 45, 20, 6
_STOPS, _QUOTES = FINAL + ":", (">", "|", "&")
_MAY_END = frozenset(".!?" + AFTER)
_QUOTE = re.compile(r"^(?:[>|]\s?|&gt;\s?)+\s*")
_BULLET = re.compile(r"^(?:[-*•·–+・]|\d{1,3}[.)]|\(?[a-z]\))\s+|^[・•]")
_BOUNDARY = re.compile(r"boundary=\"?([^\s\";]+)", re.I)
_DASHES = re.compile(r"(?m)^--([^\s-][^\s]{5,}|-+=?_[^\s]{5,}|[^\s]{8,}?)\s*$")
_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:(?:\s|$)")
_MARK = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\(more\)|\(\.\.\.\)|\[more\]|\[truncated\])$")
_TAG = re.compile(r"<[^<>]*>")
_TABLE = re.compile(r"\t|\s{3,}|\|.*\|")
_KANA = re.compile(r"[぀-ヿ一-鿿]")
_DIGIT = re.compile(r"\d")
_BASE64 = re.compile(r"^[A-Za-z0-9+/]{20,}={0,2}$")


def header_end(text: str) -> int:
    """Where the header block ends; 0 without one, -1 if the text ends inside it."""
    first = text.split("\n", 2)
    if not _HEADER.match(first[0]) or (len(first) > 1 and first[1].strip() and not (_HEADER.match(first[1]) or first[1][:1] in " \t")):
        return 0
    m = re.search(r"\r?\n\r?\n", text)
    return m.end() if m else -1


def paragraph_ended(text: str) -> bool:
    return text.endswith(("\n\n", "\r\n\r\n"))


def structure(text: str, start: int) -> tuple[list[str], str]:
    """What the text opened (header, part, html, encoded), and the outermost of it that is not closed at its end, or 'closed' if a closing token is the last thing."""
    if start < 0:
        return ["header"], "" if paragraph_ended(text) else "header"
    opened, open_ = (["header"] if start else []), ""
    head, body = text[:start], text[start:]
    names = _BOUNDARY.findall(head) if start else []
    found = {m.group(1) for m in _DASHES.finditer(body)} if "\n--" in body or body.startswith("--") else set()
    closed = {b for b in found if b.endswith("--")}
    parts = set(names) | {b for b in found - closed if b + "--" in body or _part_follows(body, b)}
    if parts and body.strip():
        opened.append("part")
        if any(f"--{b}--" not in body for b in parts):
            open_ = "part"
    low = body.lower()
    if "<html" in low:
        opened.append("html")
        if "</html" not in low:
            open_ = open_ or "html"
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    if not open_ and (last.lower().endswith("</html>") or any(last == f"--{b}--" for b in parts)):
        return opened, "closed"
    if start and re.search(r"(?i)transfer-encoding:\s*base64", head):
        data = re.sub(r"\s", "", body)
        if _BASE64.match(last) or _BASE64.match(data[:200]):
            opened.append("encoded")
            open_ = open_ or ("encoded" if len(data) % 4 else "closed")
    elif start and re.search(r"(?i)quoted-printable", head):
        opened.append("encoded")
        if re.search(r"=[0-9A-F]?$", text.rstrip()):
            open_ = open_ or "encoded"
    return opened, open_


def _part_follows(body: str, boundary: str) -> bool:
    i = body.find("--" + boundary)
    return i >= 0 and bool(re.match(r"\s*Content-", body[i + 2 + len(boundary) : i + 60 + len(boundary)]))


def plain(line: str) -> str:
    return _QUOTE.sub("", line).strip() if line[:1] in _QUOTES else line.strip()


def shape(token: str) -> str:
    """The kind of a token by its last signs: final, closing, comma, sign, or else by its letters."""
    last = token[-1:]
    if not last.isalnum():
        if token.rstrip(AFTER)[-1:] in FINAL and token.rstrip(AFTER):
            return "."
        if last in AFTER:
            return ")"
        if last in ",;:":
            return last if last == ":" else ","
        return "-"
    if not token.isalpha():
        if _DIGIT.search(token):
            return "0"
        if "@" in token or "/" in token:
            return "@"
    return "X" if len(token) > 1 and token.isupper() else "A" if token[0].isupper() else "a"


def _bullet(line: str) -> bool:
    """Whether an item's mark stands before the line; one letter is enough to rule it out in most lines."""
    c = line[0]
    return not ("A" <= c <= "Z" or ("a" <= c <= "z" and line[1:2] != ")")) and bool(_BULLET.match(line))


def _sentence_end(tokens: list[str]) -> int:
    """Behind the first token that ends a sentence which another one follows; all tokens: none."""
    for i, t in enumerate(tokens):
        if t[-1] in _MAY_END and t.rstrip(AFTER)[-1:] in ".!?" and i + 1 < len(tokens) and not tokens[i + 1][0].islower():
            return i + 1
    return len(tokens)


def _places(line: str, tokens: list[str], wrapped: bool) -> list[tuple[str, list[str]]]:
    """The line's tokens by their place, in order."""
    if _bullet(line):
        first = "b"
    else:
        first = "w" if wrapped else "t" if ("|" in line or "\t" in line or "   " in line) and _TABLE.search(line) else "h"
    cut = len(tokens)
    if ". " in line or "! " in line or "? " in line:
        cut = _sentence_end(tokens)
    rest = [("s", tokens[cut:])] if cut < len(tokens) else []
    if first == "h" and cut > FEW_WORDS:
        return [("h", tokens[:FEW_WORDS]), ("l", tokens[FEW_WORDS:cut]), *rest]
    return [(first, tokens[:cut]), *rest]


def _japanese(line: str) -> bool:
    return not line.isascii() and len(_KANA.findall(line)) >= 8


def _wraps(line: str, japanese: bool) -> bool:
    return len(line) >= (JAPANESE_WRAP if japanese else WRAP) and line.rstrip(AFTER)[-1:] not in _STOPS


def _indented(raw: str) -> bool:
    """An indented line begins something of its own."""
    return raw[:1] in (" ", "\t")


def body_lines(text: str, start: int) -> list[tuple[str, str]]:
    """The lines behind the headers, as they are without tags and without the marks of quoting, up to the last one that is not blank; start: header_end of the text."""
    if start < 0:
        return []
    body = text[start:] if start else text
    lines = (_TAG.sub(" ", body) if "<" in body else body).replace("\r", "").split("\n")
    out = [(x, plain(x)) for x in lines]
    while out and not out[-1][1]:
        out.pop()
    return out


class Uses:
    """How often each token is used in each place, and where lines, items and paragraphs end; short lines count as tokens of their own, and long ones by
    their start, marked by a line end behind it."""

    def __init__(self):
        self.new()

    def new(self) -> None:
        self.by = {c: Counter() for c in PLACES}
        self.ends = {c: Counter() for c in PLACES}
        self.blank = Counter()
        self.lines: Counter = Counter()

    def __len__(self) -> int:
        return sum(map(len, self.by.values())) + len(self.lines)

    def add(self, lines: list[tuple[str, str]], ended: bool) -> None:
        """lines of body_lines; ended: a blank line follows them. The very last token and line of a text are left out, they may be cut: only lines count that more text or a blank line follows."""
        last = len(lines) - 1
        got: dict[str, list[str]] = {c: [] for c in PLACES}
        stops: dict[str, list[str]] = {}
        keys: list[str] = []
        wrapped, above_quoted = False, False
        for i, (raw, line) in enumerate(lines):
            if not line:
                wrapped = False
                continue
            quoted = raw[:1] in _QUOTES
            tokens = line.split()
            short = len(tokens) <= FEW_WORDS and len(line) <= 60
            if not short:
                start = " ".join(tokens[:FEW_WORDS])  # as it stands in the line, unless there are other blanks
                keys.append("\n" + (start[:61] if len(tokens) > FEW_WORDS and line.startswith(start) else line_start(line)) + "\n")
            elif i < last or ended:
                keys.append("\n" + line)
            inner = i < last or ended
            japanese = not line.isascii() and _japanese(line)
            if japanese:
                c = "i" if _bullet(line) else "j"
                got[c] += [line[k : k + 2] for k in range(len(line) - (1 if inner else 2))]
                c_end, token = c, line[-2:]
            else:
                parts = _places(line, tokens, wrapped and quoted == above_quoted and not _indented(raw))
                c_end, token = parts[-1][0], parts[-1][1][-1]
                if not inner:
                    parts[-1][1].pop()
                for c, ts in parts:
                    got[c] += ts
            goes_on = i < last and bool(lines[i + 1][1]) and _wraps(line, japanese) and not _bullet(lines[i + 1][1])
            if inner and (not goes_on or c_end == "t"):
                stops.setdefault(c_end, []).append(token)
                if raw[-1:] in (" ", "\t"):
                    self.blank[c_end] += 1
            wrapped, above_quoted = goes_on and c_end not in "t", quoted
        for c, ts in got.items():
            if ts:
                self.by[c].update(ts)
        for c, ts in stops.items():
            self.ends[c].update(ts)
        self.lines.update(keys)

    def take(self) -> list[tuple[str, int, int, int]]:
        """(token, uses, ends in prose, other ends), and for each place and shape, as a token after a zero sign, (signs a cut could leave there, ends, 0);
        starts anew."""
        out: dict[str, list[int]] = {}
        sums: dict[tuple[str, str], list[int]] = {}
        for c, counts in self.by.items():
            here = {"_": counts.total()} if counts else {}
            for t, n in counts.items():
                if t in out:
                    out[t][0] += n
                else:
                    out[t] = [n, 0, 0]
                s = shape(t)
                here[s] = here.get(s, 0) + n
                if c not in "ji":
                    s = shape(t[:-1] or t)
                    here[s] = here.get(s, 0) + n * (len(t) - 1)
            for s, k in here.items():
                sums[c, s] = [k, 0]
        for c, counts in self.ends.items():
            for t, n in counts.items():
                out.setdefault(t, [0, 0, 0])[1 if c in PROSE else 2] += n
                sums.setdefault((c, shape(t)), [0, 0])[1] += n
        for c, n in self.blank.items():
            sums.setdefault((c, "_"), [0, 0])[1] += n
        rows = [(t, *x) for t, x in out.items()]
        rows += [(k, n, 0, 0) for k, n in self.lines.items()]
        rows += [(f"\0{c}{s}", *x, 0) for (c, s), x in sums.items()]
        self.new()
        return rows


def closing(lines: list[tuple[str, str]]) -> tuple[str, str, str, str, bool]:
    """(place, shape, token, line, marked) of the closing token of body_lines: the line as a key where it is short, marked if a sign of omission stood behind the token, which
    the token is then without. Place is '' if nothing is there to be judged."""
    if not lines:
        return "", "", "", "", False
    (raw, line), marked = lines[-1], False
    behind = raw[-1:] in (" ", "\t")  # the next word was to come
    key = "\n" + line if len(line.split()) <= FEW_WORDS and len(line) <= 60 else ""
    m = _MARK.search(line)
    if m and line[: m.start()].strip():
        behind, marked, line = line[m.start() - 1] in (" ", "\t"), True, line[: m.start()].strip()
    tokens = line.split()
    if _japanese(line):
        place, token = ("i" if _BULLET.match(line) else "j"), line[-2:]
    else:
        over, above = lines[-2] if len(lines) > 1 else ("", "")
        wrapped = bool(above) and _wraps(above, _japanese(above)) and not _BULLET.match(line) and not _indented(raw) and (over[:1] in _QUOTES) == (raw[:1] in _QUOTES)
        place, ts = _places(line, tokens, wrapped)[-1]
        token = ts[-1]
    return place, "_" if behind else shape(token), token, key, marked


def line_start(line: str) -> str:
    """The first words of a line, as far as a line key can reach and one sign more."""
    parts = line.split(None, FEW_WORDS)
    return (line[: len(line) - len(parts[FEW_WORDS])].rstrip() if len(parts) > FEW_WORDS else line)[:61]
