"""Operator 4: secrets by pattern and by dictionary-primed zstandard novelty."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_texts, map_texts

#: The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "novel")

#: A candidate of the novelty test: a long unbroken string with a digit and a letter (a name and '=' before it
#: are context)...
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~-]{16,}={0,2}")
#: ...behind one of these words, at most REACH characters away.
CONTEXT = re.compile(
    r"auth|bearer|credential|private|passphrase|passwd|password|pwd|secret|signature|signing|session|token|api.?key|access.?key|client.?id|ssh-|begin|cookie|jwt|salt|hmac|webhook|licen[cs]e.?key",
    re.I | re.A,
)
REACH = 48
#: What may stand between a candidate in such a context and the next, which is then in it too: dots,
#: short segments between dots, an escape or line breaks.
JOIN = re.compile(r"(?:\.[A-Za-z0-9+/_=~-]{0,15})*\.|\\|(?:[\x20\t\"',\\]*(?:\r\n?|\n))+[\x20\t\"'>]*")
#: A private key is in a sensitive context as a whole; its last line may be shorter than a candidate.
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = "-----END"
KEY_TAIL = re.compile(r"(?:\s|\\[rn])([A-Za-z0-9+/=]{1,15})(?:\s|\\[rn])*\Z")
#: Characters before and after a candidate that prime the compressor.
AROUND = 512
#: Compressed bytes that a candidate adds, per character, from which it is reported: random strings of any alphabet
#: add 0.81 to 1, strings of known words and counting ones under 0.8.
NOVEL = 0.8
#: Even bytes before the surroundings, so that no letter is cheaper for being frequent there: what is left is what
#: repeats. Without them a random letter of 16 would cost half a byte as soon as the text holds more of its kind.
#: They stand there twice, for a compressor stores what gains too little as it is.
EVEN = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(64)) * 2

#: Words of code and identifiers that a compressor should know beforehand, one list of fixed values.
IDENTIFIERS = """
abstract access account action active address admin after algorithm alias allow amount append application apply argument
array assert assign async attribute author auth await background backup base64 batch before begin binary boolean branch
browser buffer build bundle button cache callback cancel catch category certificate change channel char charset check child
class clean client clone close cluster code collection column command comment commit common compare compile component
compress config configuration confirm connect connection console const constant constructor container content context
continue control convert cookie copy count create credential current cursor data database date debug decode default define
delete deploy description destination detail device digest dictionary directory disable disconnect display distance document
domain double download driver duration element email empty enable encode encoding encrypt endpoint engine entity entry enum
environment error escape event example except exception execute exists expire export express extend extension extract factory
false feature fetch field file filter final finally find first float folder foreign format forward frame from function future
generate generic get global graph group handle handler hash header height hidden history host href html http https icon
identifier image implement import include index init initialize inner input insert instance integer interface internal invalid
item iterator java javascript join json kernel key keyword label lambda language last layer layout length level library license
limit line link list listener load local location lock log logger login long loop machine main manager map mapping match max
member memory menu merge message metadata method migrate min mock mode model modify module monitor mount name namespace native
network node none normal null number object offset open operation operator option order origin output override owner package
page parallel parameter parent parse partition password path pattern payload pending permission pipeline platform plugin
pointer policy pool port position post prefix prepare preview print priority private process processor product profile program
project prompt property protected protocol provider proxy public publish push python query queue random range read record
redirect reference register registry release remote remove render replace replica report repository request require reset
resolve resource response restore result resume retry return revision role root route router rule runtime sample scan schedule
schema scope script search second secret section security select self send sequence serial server service session set setting
setup shard share shell shutdown signal signature simple single size sleep snapshot socket sort source split stack stage start
state static status step stop storage store stream string struct style submit subscribe success suffix super support switch
symbol sync syntax system table target task template temp test text thread throw timeout timestamp title token tool total trace
track transaction transform tree trigger true try type undefined union unique unit unknown unlock update upload upper user
username utf8 util valid validate value variable vector verify version view virtual void volume wait warning watch weight
while widget width window worker workspace wrapper write yield zone
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx 1234567890 changeme
example.com localhost 127.0.0.1 https://www. http:// -----BEGIN -----END PRIVATE KEY-----
"""


@lru_cache(maxsize=1)
def dictionary() -> zstandard.ZstdCompressionDict:
    """Identifiers in lower, capital and snake form, as raw content for the compressor."""
    words = IDENTIFIERS.split()
    forms = [*(w.upper() for w in words), *(w.title() for w in words), *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)), *words]
    return zstandard.ZstdCompressionDict(" ".join(forms).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@lru_cache(maxsize=1)
def compressor() -> zstandard.ZstdCompressor:
    """Matches from three bytes on and an optimal parse, so that short known words are found in a short string."""
    how = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=15, search_log=5, min_match=3, target_length=64,
        strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=dictionary(), compression_params=how)


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that candidate adds to its surroundings, per character.

    The surroundings alone are compressed first, behind EVEN, then with the
    candidate behind them, so that anything repeated there costs next to nothing
    and a character that is not costs a byte, whatever the alphabet.
    """
    c = compressor()
    around = EVEN + (after + "\n" + before).encode("utf-8", "replace")
    return (len(c.compress(around + candidate.encode())) - len(c.compress(around))) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, leftmost and non-overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return spans


#: A run of hex digits is taken whole, so asking for its length at once finds the same runs.
LONG_HEX = re.compile(HEX.pattern[:-1] + "{%d,}" % LEAST["hex"])


def key_blocks(text: str) -> list[tuple[int, int]]:
    """What stands between the first and last line of each private key."""
    found, at = [], 0
    while m := KEY_BEGIN.search(text, at):
        end = text.find(KEY_END, m.end())
        if end < 0:
            break
        found.append((m.end(), end))
        at = end
    return found


def mixed(word: str) -> bool:
    """Whether it has a digit and a letter, as keys do."""
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


def without_others(text: str, start: int, end: int, places: list[tuple[int, int]], at: int, step: int) -> str:
    """text[start:end] without the other candidates there: copies of a key, or more keys, tell nothing of it.

    places are all candidates of text; those from number at on, in direction
    step, are looked at until one lies outside.
    """
    cuts = []
    while 0 <= at < len(places) and places[at][0] < end and places[at][1] > start:
        cuts.append((max(places[at][0], start), min(places[at][1], end)))
        at += step
    out, last = [], start
    for a, b in sorted(cuts):
        out.append(text[last:a])
        last = b
    return "".join([*out, text[last:end]])


@dataclass(frozen=True)
class Novelty:
    """least: bytes per character from which a candidate is reported; reach: characters before it in which a
    sensitive word makes it one, whole_line: or anywhere before it in its line; around: characters on each side
    that prime the compressor."""

    least: float = NOVEL
    reach: int = REACH
    whole_line: bool = False
    around: int = AROUND


class Taken:
    """Spans joined where they overlap, to be asked in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def incompressible(text: str, how: Novelty = Novelty()) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context that do not compress.

    Other candidates nearby do not count as surroundings. A candidate that
    a dot or a line break joins to one in a sensitive context is in it too, and
    so is what stands inside a private key; a sensitive word in an earlier line
    and more than how.reach characters before a candidate is not seen otherwise.
    """
    found: list[tuple[int, int, str]] = []
    places = [m.span() for m in CANDIDATE.finditer(text)]
    keyed = [s for s in places if mixed(text[slice(*s)])]
    if not keyed:
        return found
    words = [m.end() for m in CONTEXT.finditer(text)]

    def told(start: int) -> bool:
        i = bisect_right(words, start) - 1
        return i >= 0 and (words[i] > start - how.reach or how.whole_line and text.rfind("\n", words[i], start) < 0)

    number = {s: i for i, s in enumerate(keyed)}
    keys = key_blocks(text) if KEY_END in text else []
    inside = Taken([(a, b, "") for a, b in keys])
    sensitive = -1
    for start, end in places:
        joined = sensitive >= 0 and JOIN.fullmatch(text, sensitive, start)
        if not joined and not told(start) and not inside.touches(start, start + 1):
            sensitive = -1
            continue
        sensitive = end
        at = number.get((start, end))
        if at is None:
            continue
        before = without_others(text, max(0, start - how.around), start, keyed, at - 1, -1)
        after = without_others(text, end, min(len(text), end + how.around), keyed, at + 1, 1)
        if novelty(text[start:end], before, after) >= how.least:
            found.append((start, end, "novel"))
    own = Taken(found)
    for a, b in keys:
        tail = KEY_TAIL.search(text, max(a, b - how.around), b)
        if tail and own.touches(a, b) and not own.touches(*tail.span(1)):
            found.append((*tail.span(1), "novel"))
    return found


def novel_spans(text: str, taken: list[tuple[int, int, str]], how: Novelty = Novelty()) -> list[tuple[int, int, str]]:
    """Incompressible strings that no span of taken touches."""
    held = Taken(taken)
    return [s for s in incompressible(text, how) if not held.touches(s[0], s[1])]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find_secrets(df: DataFrame, how: Novelty = Novelty(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Secrets of each text: pattern spans, and strings that a primed compressor can't shorten.

    Columns: keep, n_assign, n_access, n_hex long, n_novel long (spans that the
    method adds), n_incompressible long (those and what the patterns found too),
    base_sha256, spans ("kind:start:end", code points, end exclusive, by start
    and then kind). A null
    or empty text has none; a null doc_id stays null; repeated rows and equal
    texts give equal rows; other columns of df are left out. No shuffle; only
    candidates are compressed, each with at most 2 * how.around characters around
    it, so a text costs its length.
    """

    def run(texts: list[str]) -> list[list]:
        rows = []
        for t in texts:
            base = base_spans(t)
            every, held = incompressible(t, how), Taken(base)
            more = [s for s in every if not held.touches(s[0], s[1])]
            kinds = [k for _, _, k in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), len(every), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
        return [list(c) for c in zip(*rows, strict=True)]

    return map_texts(df, run, "n_assign long, n_access long, n_hex long, n_novel long, n_incompressible long, base_sha256 string, spans string", keep, text)


def redact(df: DataFrame, mark: str = "[SECRET]", how: Novelty = Novelty(), text: str = "text") -> DataFrame:
    """df with every secret of the text column replaced by mark; null texts stay null.

    Overlapping spans become one mark. All other columns are kept as they are.
    """
    def run(texts: list[str]) -> list[list]:
        out = []
        for t in texts:
            base = base_spans(t)
            spans = sorted((a, b) for a, b, _ in base + novel_spans(t, base, how))
            parts, at = [], 0
            for a, b in spans:
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return [out, [len(t) for t in out]]

    done = beside_texts(df, run, "text string, chars long", tuple(df.columns), text)
    held = lambda c: F.col("kept").getField(c)
    there = held(text).isNotNull()
    new = {text: F.when(there, F.col("text"))}
    if "n_chars" in df.columns and text != "n_chars":
        new["n_chars"] = F.when(there, F.col("chars").cast(df.schema["n_chars"].dataType)).otherwise(held("n_chars"))
    return done.select(*[new.get(c, held(c)).alias(c) for c in df.columns])
