"""BPE through a merge-type prefix table.

For every prefix of a unit of text the table holds the one token that ends the prefix's encoding, and how many
tokens that encoding has. Candidates for a prefix's last token come from an Aho-Corasick automaton over the
vocabulary (all pieces that end there, longest first); the first that is compatible with the last token of what
precedes it is the right one. Two tokens are compatible if the merges that made them leave their boundary alone.
The ids are recovered backwards from the last prefix. Work is linear in the text for a bounded piece length.

A text falls into units that no piece crosses: runs of blanks with the word after them, and line ends.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import sentencepiece

BLANK = "▁"
#: Units up to this many characters are remembered, in two generations of so many.
UNIT_CHARS, UNITS = 48, 200_000
_RUNS = re.compile(r"( *)([^ ]+)|( +)")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixBPE:
    """Encoder for a sentencepiece BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str):
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in byte}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(BLANK in self.piece[i].lstrip(BLANK) or "\n" in self.piece[i] for i in plain):
            raise ValueError("pieces that cross a blank or a line end are not supported")
        if any(self.piece[i].startswith(BLANK * 2) and self.piece[i].strip(BLANK) for i in plain):
            raise ValueError("pieces that join several blanks to a word are not supported")
        self.runs = {len(self.piece[i]): i for i in plain if not self.piece[i].strip(BLANK)}
        words = [i for i in plain if len(self.piece[i]) == 1 or self.piece[i].strip(BLANK)]
        order = sorted((i for i in words if len(self.piece[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        #: When a piece comes into being: single characters are there from the start.
        self.born = [-1] * n
        for k, i in enumerate(order):
            self.born[i] = k
        self.id = {self.piece[i]: i for i in words}
        self.size = [len(p) for p in self.piece]
        self.left, self.right = [-1] * n, [-1] * n
        self.pairs: dict[int, bool] = {}
        reachable = [i for i in words if len(self.piece[i]) == 1]
        for i in order:
            p, at = self.piece[i], self.born[i]
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None and self._made(a) and self._made(b) and self.born[a] < at and self.born[b] < at and self._apart(a, b, at):
                    self.left[i], self.right[i] = a, b
                    reachable.append(i)
                    break
        self.auto = ahocorasick.Automaton()
        for i in reachable:
            self.auto.add_word(self.piece[i], i)
        self.auto.make_automaton()
        self.longest_run = max(self.runs)
        self.run_table = [self._run(k) for k in range(2 * self.longest_run)]
        self.after_blank, self.at_start = _Memory(self, BLANK), _Memory(self, "")
        self.counts = _Counts(self, BLANK), _Counts(self, "")
        #: Pairs of characters that some piece holds side by side.
        self.inside = {p[k : k + 2] for p in map(self.piece.__getitem__, words) for k in range(len(p) - 1)}

    def tails(self, memory: _Memory) -> _Memory:
        """The memory of the same kind for text that doesn't follow a blank."""
        return self.counts[1] if isinstance(memory, _Counts) else self.at_start

    def _made(self, i: int) -> bool:
        return self.size[i] == 1 or self.left[i] >= 0

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge before ``until`` crosses the boundary of a and b: their makings are undone, latest first."""
        piece, born, ids = self.piece, self.born, self.id
        while True:
            joint = ids.get(piece[a] + piece[b])
            if joint is not None and born[joint] < until:
                return False
            if born[a] > born[b]:
                until = born[a]
                a = self.right[a]
            elif born[b] >= 0:
                until = born[b] + 1  # of equal merges the left one comes first
                b = self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, 1 << 40)
        return known

    def _run(self, n: int) -> list[int]:
        """Token sizes of n blanks: their merges have one score, so the leftmost possible merge always comes next."""
        parts = [1] * n
        while True:
            k = next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.runs), None)
            if k is None:
                return [self.runs[p] for p in parts]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def blanks(self, n: int) -> list[int]:
        whole = max(0, n // self.longest_run - 1)
        return [self.runs[self.longest_run]] * whole + self.run_table[n - whole * self.longest_run]

    def prefix_table(self, unit: str) -> tuple[list[int], list[int]]:
        """For each prefix of the unit: its last token (-1: a character outside the vocabulary) and its token count."""
        n = len(unit)
        last, count, done = [-1] * (n + 1), [0] * (n + 1), 0
        size, pairs, compatible = self.size, self.pairs, self.compatible
        for at, tok in self.auto.iter(unit):
            end = at + 1
            if end == done:
                continue
            while done < end - 1:
                count[done + 1] = count[done] + len(unit[done].encode())
                done += 1
            start = end - size[tok]
            before = last[start]
            if before < 0:
                fits = True
            else:
                fits = pairs.get(before << 20 | tok)
                if fits is None:
                    fits = compatible(before, tok)
            if fits:
                last[end], count[end], done = tok, count[start] + 1, end
        while done < n:
            count[done + 1] = count[done] + len(unit[done].encode())
            done += 1
        return last, count

    def unit_ids(self, unit: str) -> list[int]:
        last, _ = self.prefix_table(unit)
        out, at = [], len(unit)
        while at:
            tok = last[at]
            if tok < 0:
                at -= 1
                out.extend(self.byte[x] for x in reversed(unit[at].encode()))
            else:
                out.append(tok)
                at -= self.size[tok]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        newline = array("I", [self.byte[10]]).tobytes()
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            if "  " in line or line.endswith(" ") or (not k and line.startswith(" ")):
                out += self._spaced(line if k else " " + line)
            elif k:
                first, *words = line.split(" ")
                if first:
                    out.append(self.at_start[first])
                out += map(self.after_blank.__getitem__, words)
            elif line:
                out += map(self.after_blank.__getitem__, line.split(" "))
            else:
                out.append(array("I", self.blanks(1)).tobytes())
        return b"".join(out)

    def _spaced(self, line: str) -> list[bytes]:
        """Units of a line with runs of blanks, trailing ones too."""
        out, alone = [], array("I", self.blanks(1)).tobytes()
        for blanks, word, tail in _RUNS.findall(line):
            if tail:
                out.append(array("I", self.blanks(len(tail))).tobytes())
            elif not blanks:
                out.append(self.at_start[word])
            else:
                ids, free = self.after_blank[word], len(blanks) - 1
                if free and ids[:4] == alone:
                    ids, free = ids[4:], free + 1
                if free:
                    out.append(array("I", self.blanks(free)).tobytes())
                out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)

    # Counting: the same table, read for its counts.

    def count(self, text: str) -> int:
        if not text:
            return 0
        if BLANK in text:
            text = text.replace(BLANK, " ")
        blank, start = self.counts
        lines = text.split("\n")
        total = len(lines) - 1
        for k, line in enumerate(lines):
            if "  " in line or line.endswith(" ") or (not k and line.startswith(" ")):
                total += sum(len(x) for x in self._spaced(line if k else " " + line)) // 4
            elif k:
                first, *words = line.split(" ")
                total += (start[first] if first else 0) + sum(map(blank.__getitem__, words))
            else:
                total += sum(map(blank.__getitem__, line.split(" "))) if line else 1
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of every prefix of the text; entry i is that of its first i characters.

        A prefix ends inside at most one unit, so its count is that of the whole units before it plus what the unit's own
        table holds at that place.
        """
        if BLANK in text:
            text = text.replace(BLANK, " ")
        out, total = [0], 0
        for k, line in enumerate(text.split("\n")):
            if k:
                total += 1
                out.append(total)
            counts, all_ = self._line_counts(line, not k and bool(text))
            out += [total + x for x in counts]
            total += all_
        return out

    def _line_counts(self, line: str, first: bool) -> tuple[list[int], int]:
        """Token counts of a line's prefixes of one character and more; then that of all it holds. A text's first line has the dummy prefix."""
        out, total = [], 0
        for blanks, word, tail in _RUNS.findall(" " + line if first else line):
            n = len(blanks or tail)
            out += [total + len(self.blanks(i)) for i in range(2 if first and not total else 1, n + 1)]
            if tail:
                total += len(self.blanks(n))
                continue
            unit = BLANK + word if n else word
            last, count = self.prefix_table(unit)
            single = self._single(unit, last) if n > 1 else None
            extra = 0
            for i in range(2 if n else 1, len(unit) + 1):
                if n > 1:
                    extra = len(self.blanks(n)) - 1 if single[i] else len(self.blanks(n - 1))
                out.append(total + extra + count[i])
            total = out[-1]
        return out, total

    def _single(self, unit: str, last: list[int]) -> list[bool]:
        """Whether the encoding of each prefix begins with a blank that no other character joined."""
        first = [-1] * (len(unit) + 1)
        for end in range(1, len(unit) + 1):
            start = end - (self.size[last[end]] if last[end] >= 0 else 1)
            first[end] = first[start] if start else last[end]
        alone = self.runs[1]
        return [x == alone for x in first]

    def cut(self, text: str, budget: int) -> int:
        """Most characters of the text whose encoding has at most ``budget`` tokens, from the prefix table alone."""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        total = at = 0
        blank, start = self.counts
        # Whole units count from memory; the table is laid out only where the budget ends.
        for k, line in enumerate(text.split("\n")):
            if k:
                if total + 1 > budget:
                    return at
                total, at = total + 1, at + 1
            first = not k and bool(text)
            if not line or "  " in line or line.endswith(" ") or (first and line.startswith(" ")):
                counts, all_ = self._line_counts(line, first)
                if total + all_ > budget:
                    return at + self._fit(counts, budget - total)
                total, at = total + all_, at + len(line)
                continue
            for j, word in enumerate(line.split(" ")):
                lead = BLANK if j or first else ""
                n = (blank if lead else start)[word] if lead or word else 0
                if total + n > budget:
                    hidden = first and not j
                    return at + self._fit(self.prefix_table(lead + word)[1][1 + hidden :], budget - total)
                total, at = total + n, at + len(word) + (1 if j else 0)
        return at

    @staticmethod
    def _fit(counts: list[int], budget: int) -> int:
        """A longer prefix can have fewer tokens, so the last fitting place is looked for from the end."""
        return next((i for i in range(len(counts), 0, -1) if counts[i - 1] <= budget), 0)


class _Memory(dict):
    """What is known of units that came before. When it is full it becomes the old generation, and units met again move on from there."""

    def __init__(self, bpe: PrefixBPE, lead: str):
        self.bpe, self.lead, self.old = bpe, lead, {}

    def make(self, word: str):
        """Ids, as bytes."""
        return array("I", self.bpe.unit_ids(self.lead + word)).tobytes()

    def __missing__(self, word: str):
        got = self.old.pop(word, None)
        if got is None:
            # No piece joins the last two characters: what they belong to is encoded apart, and mostly known.
            apart = len(word) > 1 and word[-2:] not in self.bpe.inside
            got = self[word[:-1]] + self.bpe.tails(self)[word[-1]] if apart and len(word) <= UNIT_CHARS else self.make(word)
        if len(word) <= UNIT_CHARS:
            if len(self) >= UNITS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class _Counts(_Memory):
    """Token counts of units that came before."""

    def make(self, word: str) -> int:
        return self.bpe.prefix_table(self.lead + word)[1][-1]


_LOADED: dict[str, PrefixBPE] = {}


def load(path: str | None = None) -> PrefixBPE:
    """The encoder of a model file, built once in each Python worker."""
    path = path or default_model()
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]
