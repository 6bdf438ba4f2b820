"""Secret scanning with one combined automaton over bytes.

All rules are scanned together: each byte of a text is looked at once. Many stretches of
text are run side by side, a vector of states stepping through a vector of bytes. The state
in which a stretch begins is first guessed from the bytes before it; where the stretch
before ends in another state, it is run again from that one, so matches may have any length.
Where rules end in a text, their reversed automata mark the starts and their forward ones
find the longest match from each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_rules, parse, reverse
from .common import ship



def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(any_case, ("api_?key", "access_key", "secret", "token", "passwd", "password")))

#: Name and expression of each rule; matches may be of any length. A leading \b stands for
#: the text's start or a byte that is no letter, digit, _ or - before the match.
RULES = {
    "assigned_secret": rf"""(?:{_KEYS}) ?[=:] ?["'][0-9A-Za-z_+/=.~-]{{16,}}["']""",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"\bgh[opsur]_[0-9A-Za-z]{36}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}",
    "payment_key": r"\b[rs]k_live_[0-9A-Za-z]{16,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
}

#: Bytes of a stretch, bytes before it that guess its first state, stretches side by side at most.
STRETCH, WARM, LANES = 4096, 64, 16384


#: The bytes that may come before a rule's match where it asks for a boundary.
OUTSIDE = parse("[^0-9A-Za-z_-]")[1][0][1]


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.names, self.bounded = list(rules), [v.startswith(r"\b") for v in rules.values()]
        nodes = [parse(v.removeprefix(r"\b")) for v in rules.values()]
        self.forward = compile_rules([("cat", [("set", OUTSIDE), v]) if b else v for b, v in zip(self.bounded, nodes)])
        self.starts = [compile_rules([reverse(v)]) for v in nodes]
        self.single = [compile_rules([v], anywhere=False) for v in nodes]
        if empty := [n for n, a in zip(self.names, self.single) if a.start >= a.accept_from]:
            raise ValueError(f"rules that match nothing at all: {empty}")
        self.dead = [a.dead() for a in self.single]

    def _run(self, kind: np.ndarray, begin: np.ndarray, stop: np.ndarray, state: np.ndarray, found: dict | None) -> np.ndarray:
        """The state of each stretch at its end; `found` gets the places and states that end matches."""
        a: Automaton = self.forward
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        out = state.copy()
        for at in range(0, len(order), LANES):
            lane = order[at : at + LANES]
            place, length, now = begin[lane].copy(), (stop - begin)[lane], state[lane]
            shrink = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # stretches longer than the step
            for k in shrink.tolist():
                if k < len(now):
                    out[lane[k : len(now)]] = now[k:]
                    now, place = now[:k], place[:k]
                now = a.table[now + kind[place]]
                place += 1
                if found is not None and now.max() >= a.accept_from:
                    for i in np.flatnonzero(now >= a.accept_from).tolist():
                        found.setdefault(int(lane[i]), []).append((int(place[i]), a.rules_at(int(now[i]))))
            out[lane[: len(now)]] = now
        return out

    def ends(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(position after the match, rules that end there), for texts raw[offsets[i]:offsets[i+1]]."""
        a: Automaton = self.forward
        sizes = np.diff(offsets)
        cuts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), cuts)
        if not len(text):
            return []
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = offsets[text] + nth * STRETCH
        stop = np.minimum(begin + STRETCH, offsets[text + 1])
        first = nth == 0
        kind, found = a.classes[raw], {}
        state = np.full(len(text), a.start, np.int32)
        state[first] = a.table[a.start + int(a.classes[10])]  # as after a line's end
        later = np.flatnonzero(~first)
        if len(later):
            state[later] = self._run(kind, begin[later] - WARM, begin[later], state[later], None)
        end = self._run(kind, begin, stop, state, found)
        while len(again := later[end[later - 1] != state[later]]):  # guessed wrong
            state[again] = end[again - 1]
            some: dict[int, list] = {}
            end[again] = self._run(kind, begin[again], stop[again], state[again], some)
            for k, lane in enumerate(again.tolist()):
                found[lane] = some.get(k, [])
        return sorted(x for some in found.values() for x in some)

    def matches(self, text: bytes, ends: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """(rule, start, end) in bytes: of each rule the leftmost-longest matches that don't overlap."""
        out = []
        for k, name in enumerate(self.names):
            places, a, marked, p = [e for e, rules in ends if rules >> k & 1], self.starts[k], [], len(text)
            classes, table = a.classes.tolist(), a.table
            while places:  # back from the last end, until nothing of a match is open
                p, state = min(p, places.pop()), a.start
                while p:
                    p -= 1
                    state = int(table[state + classes[text[p]]])
                    if state >= a.accept_from and not (self.bounded[k] and p and not OUTSIDE >> text[p - 1] & 1):
                        marked.append(p)
                    if state == a.start:
                        break
                while places and places[-1] > p:
                    places.pop()
            a, last = self.single[k], 0
            classes, table = a.classes.tolist(), a.table
            for start in reversed(marked):
                if start < last:
                    continue
                state, end = a.start, start
                for p in range(start, len(text)):
                    state = int(table[state + classes[text[p]]])
                    if state == self.dead[k]:
                        break
                    if state >= a.accept_from:
                        end = p + 1
                out.append((name, start, end))
                last = end
        return out


def scan_secrets(docs: DataFrame, rules: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, nth, start, end, secret): every match of every rule in every row.

    `start` and `end` count UTF-8 bytes, `nth` counts a rule's matches in a row from 1. Null
    and empty texts match nothing; repeated or null ids are reported row by row. Texts and
    matches of any length are scanned whole; ids may be of any type, and an empty table
    gives no rows. One narrow stage: no shuffle, and what is sent to the
    tasks is the compiled rules.
    """
    ship(docs.sparkSession)
    scanner = Scanner(RULES if rules is None else rules)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
            hits: dict[int, list] = {}
            for end, rules_ in scanner.ends(raw, offsets):
                i = int(np.searchsorted(offsets, end, "left")) - 1
                hits.setdefault(i, []).append((end - int(offsets[i]), rules_))
            rows = []
            for i, ends in sorted(hits.items()):
                text, seen = texts[i].as_py(), {}
                for rule, start, end in scanner.matches(text, ends):
                    seen[rule] = seen.get(rule, 0) + 1
                    rows.append((i, rule, seen[rule], start, end, text[start:end].decode("utf-8", "replace")))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())))], ["id", "rule", "nth", "start", "end", "secret"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, f"id {kind}, rule string, nth int, start int, end int, secret string").withColumnRenamed("id", "doc_id")
