"""Rule tables and constants of the dataset builder.

Everything between the two ``FIXED VALUES`` markers must stay equal to the
behaviour being reproduced: patterns, their order, replacement tokens and
workload constants. The patterns are written in the portable subset shared by
Python ``re`` and RE2; :func:`java_regex` turns one into the JVM dialect that
Spark's ``rlike`` / ``regexp_replace`` use, and :func:`re2_regex` is the form
for DuckDB. Nothing here is a Spark object, so the module is importable on the
driver and in tests without a session.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; do not edit)
# ---------------------------------------------------------------------------

# Harm categories in evaluation order; the first category with a matching
# pattern wins. Matching runs on the lower-cased text.
HARM_PATTERNS: dict[str, list[str]] = {
    "hacking": [
        r"\b(?:keylogger|metasploit|buffer overflow|ddos attack|sql injection|ransomware|malware payload|zero-day exploit|reverse shell|privilege escalation)\b",
        r"\b(?:bypass auth|crack password|steal credentials|botnet|remote code execution|rat trojan)\b",
    ],
    "explosives": [
        r"\b(?:bomb recipe|make explosive|anfo|tnt synthesis|pipe bomb|c4 synthesis|detonator|ied assembly|fertilizer bomb)\b",
        r"\b(?:how to make gunpowder|chemical weapon|mustard gas synthesis|ricin recipe)\b",
    ],
    "sexual": [
        r"\b(?:explicit sexual|pornography|erotic roleplay|nude pictures|sexually explicit|nsfw content|erotica)\b",
    ],
    "harm": [
        r"\b(?:how to commit suicide|self-harm instructions|how to kill|murder plan|assassination|physical assault|torture method)\b",
    ],
}

# Personal-data patterns, applied one after the other in this order.
PII_PATTERNS: dict[str, str] = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "api_key": r"\b(?:sk-[a-zA-Z0-9]{20,}|AIzaSy[a-zA-Z0-9_-]{33}|ghp_[a-zA-Z0-9]{36})\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
PII_REPLACEMENTS: dict[str, str] = {
    "email": "[REDACTED_EMAIL]",
    "phone": "[REDACTED_PHONE]",
    "ssn": "[REDACTED_SSN]",
    "api_key": "[REDACTED_API_KEY]",
    "ip": "[REDACTED_IP]",
}

# One message-log line: timestamp, sender, content (matched on the stripped line).
LOG_LINE_PATTERN = r"^\[?(\d{1,2}/\d{1,2}/\d{2,4},\s\d{1,2}:\d{2}:\d{2}\s?[AP]?M?)\]?\s([^:]+):\s(.*)$"
MEDIA_PREFIX = "<Media omitted>"

# Note files are read when the name ends with one of these (case-sensitive).
NOTE_EXTENSIONS = (".txt", ".md", ".json")
NOTE_INSTRUCTION_PREFIX = "Elaborate on the personal notes regarding: "

CHAT_ROLES = ("user", "assistant")  # kept roles of a chat-tree export
DEFAULT_CHUNK_WORDS = 500  # words per note chunk
MIN_CHUNK_CHARS = 50  # a chunk is kept when strictly longer than this
LOG_WINDOW = 6  # messages per message-log conversation
MIN_TURNS = 2  # a conversation is kept with at least this many messages
FORMATS = ("sharegpt", "alpaca", "jsonl")

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Code points Python's ``str.isspace`` accepts, i.e. what ``str.strip()`` /
# ``str.split()`` and ``\s`` in a ``str`` pattern treat as whitespace. Java's
# ``(?U)\s`` misses U+001C..U+001F and RE2's ``\s`` is ASCII-only, so every
# engine gets this explicit set instead (derived from the Unicode data that
# ships with Python, checked by the tests).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(cp) for cp in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE_CHARS)
WS = "[" + WHITESPACE_CLASS + "]"


# Python's ``\w``: letters, numbers of every kind and the underscore. Java's ``(?U)\w``, which its ``\b`` looks at, also
# has combining marks and joiners and lacks other numerals, so ``\b`` is spelled out over Python's class.
WORD_CLASS = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD_CLASS})(?!{WORD_CLASS})|(?<!{WORD_CLASS})(?={WORD_CLASS}))"


def _expand_whitespace(pattern: str, boundary: str = r"\b") -> str:
    r"""Replace ``\s`` by the explicit whitespace class, inside or outside ``[...]``, and ``\b`` by ``boundary``."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i : i + 2]
            if esc == r"\s":
                out.append(WHITESPACE_CLASS if in_class else WS)
            elif esc == r"\b" and not in_class:
                out.append(boundary)
            else:
                out.append(esc)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


_LEADING_RUN = re.compile(r"(\[[^\]\\]+\])\+([^\\\[\](){}|*+?.^$])")


def from_run_starts(pattern: str) -> str:
    """The same matches as ``pattern`` where it begins with a run of one class and a literal outside of that class, found
    in linear time.

    Such a match takes its run up to the literal. If a run fails from its first character on, it fails from every other
    one too, so only two kinds of places can begin a match: the first character of a run, and where the last match
    ended (``\\G``). The run never gives characters back, as none of them is the literal. JVM syntax.
    """
    m = _LEADING_RUN.match(pattern)
    if m is None or re.fullmatch(m[1], m[2]):
        return pattern
    return rf"(?:(?<!{m[1]})|\G){m[1]}++{m[2]}" + pattern[m.end() :]


_PHONE_BEGIN = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d"


def java_regex(pattern: str, dotall: bool = False) -> str:
    r"""Python ``re`` (str) pattern -> JVM pattern with the same matches.

    ``(?U)`` makes ``\d`` Unicode-aware as in Python; ``\b`` and ``\s`` become
    explicit forms over Python's word and whitespace classes, and a leading run is tried once (:func:`from_run_starts`,
    for searches from left to right such as replacements). With ``dotall`` a trailing
    ``$`` becomes ``\z`` and ``.`` matches every code point, which is what a
    Python pattern sees on one already-split line.
    """
    body = _expand_whitespace(from_run_starts(pattern), BOUNDARY)
    # next to a digit the boundary has one side only, which is cheaper to test
    body = body.replace(BOUNDARY + r"\d", f"(?<!{WORD_CLASS})" + r"\d")
    body = re.sub(r"(\\d(?:\{[1-9][0-9,]*\})?)" + re.escape(BOUNDARY), lambda m: f"{m[1]}(?!{WORD_CLASS})", body)
    if pattern.startswith(_PHONE_BEGIN):  # few characters can begin a match, which is cheaper to test than the boundary
        body = r"(?=[+(\d])" + body
    if dotall and body.endswith("$"):
        body = body[:-1] + r"\z"
    return ("(?Us)" if dotall else "(?U)") + body


def re2_regex(pattern: str) -> str:
    r"""Python pattern -> RE2 (DuckDB). RE2 classes are ASCII; ``\s`` is widened."""
    return _expand_whitespace(pattern)


def harm_regex(category: str, dialect: str = "java", harm: Mapping[str, Sequence[str]] = HARM_PATTERNS) -> str:
    """All patterns of one category as a single alternation."""
    joined = "|".join(harm[category])
    return java_regex(joined) if dialect == "java" else re2_regex(joined)


def harm_phrases() -> list[str]:
    r"""The literal phrases of every harm pattern (each pattern is ``\b(?:p1|p2|...)\b``)."""
    phrases: list[str] = []
    for patterns in HARM_PATTERNS.values():
        for pattern in patterns:
            m = re.fullmatch(r"\\b\(\?:(.*)\)\\b", pattern)
            if m is None:
                raise ValueError(f"not a word-bounded alternation of literals: {pattern}")
            alternatives = m.group(1).split("|")
            if any(re.escape(a).replace("\\ ", " ").replace("\\-", "-") != a for a in alternatives):
                raise ValueError(f"non-literal alternative in {pattern}")
            phrases.extend(alternatives)
    return phrases


def phrase_trie(phrases: list[str]) -> str:
    """A regex matching exactly ``phrases``, factored on common prefixes.

    The JVM engine tries alternatives one by one at every position; sharing
    prefixes makes a failing position cost one comparison per distinct first
    character instead of one per phrase.
    """
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        branches = [re.escape(ch) + emit(node[ch]) for ch in sorted(k for k in node if k)]
        if not branches:
            return ""
        ends_here = "" in node
        body = branches[0] if len(branches) == 1 and not ends_here else "(?:" + "|".join(branches) + ")"
        return body + ("?" if ends_here else "")

    return emit(tree)


def any_harm_regex(dialect: str = "java") -> str:
    r"""Matches where any harm pattern matches: ``\b`` + prefix trie of all phrases + ``\b``.

    A cheap pre-filter for clean text; the category itself is decided by the
    original per-category patterns.
    """
    phrases = harm_phrases()
    trie = phrase_trie(phrases)
    if dialect != "java":
        return re2_regex(r"\b" + trie + r"\b")
    if not all(re.match(r"\w", p[0]) and re.match(r"\w", p[-1]) for p in phrases):
        raise ValueError("a harm phrase starts or ends with a character that is no word character")
    # next to a word character the boundary has one side only
    return java_regex(f"(?<!{WORD_CLASS}){trie}(?!{WORD_CLASS})")


# ---------------------------------------------------------------------------
# Tables of one's own
# ---------------------------------------------------------------------------

DIGIT = r"\d"  # in a set of required literals: any digit


@dataclass(frozen=True)
class RuleTables:
    """Harm categories and personal-data patterns of a run, each in the order of evaluation.

    Patterns are Python ``re`` patterns in the subset shared with the JVM and RE2; harm patterns are searched in the
    lower-cased text, replacements are literal text.
    """

    harm: Mapping[str, Sequence[str]] = field(default_factory=lambda: HARM_PATTERNS)
    pii: Mapping[str, str] = field(default_factory=lambda: PII_PATTERNS)
    replacements: Mapping[str, str] = field(default_factory=lambda: PII_REPLACEMENTS)

    def __post_init__(self):
        if missing := [kind for kind in self.pii if kind not in self.replacements]:
            raise ValueError(f"no replacement for {', '.join(missing)}")
        if taken := {"rejected", "samples", "notes_read", "file", "block", "_n"} & set(self.harm):
            raise ValueError(f"not a name for a harm category: {', '.join(sorted(taken))}")
        if empty := [category for category, patterns in self.harm.items() if not patterns]:
            raise ValueError(f"no pattern for {', '.join(empty)}")
        for pattern in [*self.pii.values(), *(p for patterns in self.harm.values() for p in patterns)]:
            re.compile(pattern)


TABLES = RuleTables()


def required_literals(pattern: str) -> frozenset[str] | None:
    """Strings of which every match of ``pattern`` holds at least one (:data:`DIGIT`: a digit), None if none are known.

    A sequence needs what any of its parts needs, alternatives the union of what all of them need, a repeat what its body
    needs if it occurs at least once. Of several answers the longest literals win, then digits.
    """
    parsed = re._parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return None

    def worth(needed: frozenset[str]) -> float:
        return min(1.5 if literal == DIGIT else len(literal) for literal in needed)

    def needs(sequence) -> frozenset[str] | None:
        found, run = [], ""
        for op, value in [*sequence, (None, None)]:
            if op is re._constants.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            inner = None
            if op is re._constants.SUBPATTERN and not value[1] & re.IGNORECASE:
                inner = needs(value[3])
            elif op is re._constants.BRANCH:
                branches = [needs(branch) for branch in value[1]]
                inner = frozenset().union(*branches) if all(branches) else None
            elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT, re._constants.POSSESSIVE_REPEAT) and value[0]:
                inner = needs(value[2])
            elif op is re._constants.ATOMIC_GROUP:
                inner = needs(value)
            elif op is re._constants.IN and list(value) == [(re._constants.CATEGORY, re._constants.CATEGORY_DIGIT)]:
                inner = frozenset([DIGIT])
            if inner:
                found.append(inner)
        return max(found, key=worth, default=None)

    return needs(parsed)


def java_replacement(text: str) -> str:
    """``text`` as a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
