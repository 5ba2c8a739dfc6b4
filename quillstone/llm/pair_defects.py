"""Broken prompt and response pairs: noisy labelling functions and an expectation-maximization label model.

How it works
------------
1. Every pair is read once. For each defect four to seven labelling functions vote for it (1), against it (-1) or abstain (0);
   each draws on evidence of another kind: words, marks, counts, flags, errors, limits.
2. The votes of a defect are counted by pattern in Spark. EM over the counts learns how often each function is right with and
   without the defect. All functions start from the same weak belief. Functions that agree more often than their common
   cause explains count for less (``strengths``).
3. Cutoffs are validated on labelled rows: all pairs taken for sound stay as they are, and each gets every defect planted (blanked, cut, refused, copied from the question, swapped with an answer in another language). The
   cutoff of a defect is the one with the best F1 on them, weighed as rare as EM found the defect. A pair keeps every defect whose posterior reaches its cutoff.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.truncation import CITATION, MARKUP, PLACEHOLDER, ending, has_content, judge, read_texts

#: Each defect with its labelling functions.
FUNCTIONS = {
    "empty": ("no_letters", "placeholder", "markup", "no_tokens", "failed"),
    "truncated": ("judged", "open_end", "unbalanced", "beyond_limit", "broken_off"),
    "refusal": ("cannot", "lacks", "must_not", "nothing_else", "abstained", "short", "uncited"),
    "copy": ("same_words", "same_order", "same_length", "asks", "uncited"),
    "other_language": ("function_words", "script", "letters", "shared_words"),
}
#: How many of the functions of a defect, the first ones, find it in the text itself. Where none of them speaks for it, shape and
#: flags alone don't make a defect.
FOUND_IN_TEXT = {"empty": 3, "truncated": 1, "refusal": 3, "copy": 2, "other_language": 3}
#: Where one type is asked for and several posteriors reach their cutoffs, the first of these.
PRECEDENCE = ("empty", "truncated", "copy", "refusal", "other_language")
#: What is believed of every function before any data: its share of right votes, with the weight of so many rows.
BELIEF, BELIEF_ROWS = 0.8, 6.0
#: A defect is never taken for rarer than this, so that a single one among very many sound pairs is still found.
LEAST_PRIOR = 0.005
#: Letters of a text beyond which the language by letters is told, and by how much a language must be ahead (log odds).
LEAST_LETTERS, AHEAD = 12, 4.0

#: Words by which languages are told apart, without accents, so that Vietnamese typed without them is known (fixed values).
FUNCTION_WORDS = {
    "vi": "khong duoc cua nhung cac trong cho khi phai theo hop dong nguoi giay tin dung cua bang ngan vay tai san thuc hien neu hoac va voi "
          "muc doi linh vuc ket qua thoi ngay gui trach nhiem vien phong ban cung cap nhan viec hang cap truong hop von bao sao kiem ho so chi "
          "nhanh duoi tren toi xin loi cau hoi tra loi chua nham gia tri trieu".split(),
    "en": "the of and must not while for is has with shall who should where which what when may does this that are was by from each after before "
          "once unless sorry cannot answer i it in which under being their there will please been were".split(),
    "fr": "le les des une est pour dans que qui doit avec par sur ne pas sont aux cette lorsque avant apres si ou et au ete faut devra "
          "je nous vous il elle sans donc ainsi chaque selon tant dont afin lors cas leur son ses ces".split(),
}
_TELLS = {w: [lang for lang, own in FUNCTION_WORDS.items() if w in own] for own in FUNCTION_WORDS.values() for w in own}
_VIETNAMESE = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
_ELIDED = re.compile("(?:l|d|qu|s|n|c)['’][^\\W\\d]")
_HAN = re.compile("[\u3400-\u9fff]")
_MARKS = re.compile("[\u0300-\u036f]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_WORD_HAN = re.compile("[\u3400-\u9fff]|[^\\W\\d_\u3400-\u9fff]+(?:['’][^\\W\\d_\u3400-\u9fff]+)?|\\d+")
#: The kind of each character of the basic plane: 0 no letter, 1 a letter, 2 a Vietnamese one, 3 an ideograph.
_KIND = np.array([3 if 0x3400 <= c <= 0x9FFF else 0 if not chr(c).isalpha() else 2 if _VIETNAMESE.match(chr(c)) else 1 for c in range(1 << 16)], np.uint8)

#: Sentences, in lower case, by which an answer as a whole declines (fixed values).
#: That one is not able to, lacks what is needed, or must not.
_CANNOT = (
    "(?:không|chưa) thể (?:trả lời (?:câu|yêu cầu|vấn đề|được)|hỗ trợ|giải đáp|cung cấp|đưa ra)|(?:ngoài|vượt) khả năng của (?:tôi|hệ thống)"
    "|\\bi\\s?(?:can’t|can't|cannot|can not|could not|couldn’t|couldn't|am unable|am not able|won’t|won't|will not)"
    "|no answer can be given|unable to (?:answer|assist|help|give)|not in a position to|(?:system|assistant) (?:cannot|can’t|can't|does not support)"
    "|无法(?:回答|提供|给出|协助)|不能(?:回答|提供)|je ne (?:peux|puis) (?:pas )?(?:répondre|vous)|impossible de répondre")
_LACKS = (
    "(?:không|chưa) đủ (?:thông tin|căn cứ|bằng chứng|dữ liệu|cơ sở)[^.!?]{0,60}(?:để trả lời|đưa ra câu trả lời|xin phép|không trả lời)"
    "|không tìm thấy (?:nội dung|thông tin)[^.!?]{0,40}trả lời|không có câu trả lời"
    "|\\bi\\s?(?:do not have|don't have|don’t have|found no|could find no)|nothing (?:was )?found to answer"
    "|(?:not enough|insufficient|too little) (?:information|evidence|context)[^.!?]{0,60}(?:to answer|for an answer|so i)"
    "|do(?:es)? not (?:hold|contain|give) enough[^.!?]{0,60}answer")
_MUST_NOT = (
    "không hỗ trợ (?:loại )?(?:câu hỏi|yêu cầu)|từ chối (?:đưa ra|trả lời|cung cấp)|xin (?:phép )?(?:được )?(?:không|từ chối) trả lời"
    "|nằm ngoài phạm vi (?:tôi|hỗ trợ|có thể)|không được phép (?:đưa ra|trả lời|cung cấp)|(?:ngoài|vượt) thẩm quyền của (?:tôi|hệ thống)"
    "|\\bi\\s?(?:must decline|have to decline|may not|am not allowed|am not permitted)|outside (?:what|the scope of what) i may"
    "|(?:does not|doesn’t|doesn't) support (?:this|that) (?:kind|type) of question|抱歉|拒绝回答|désolé")
_FAMILIES = [re.compile(p) for p in (_CANNOT, _LACKS, _MUST_NOT)]
DECLINES = re.compile("|".join((_CANNOT, _LACKS, _MUST_NOT)))
#: Reservations next to a real answer: somebody else cannot answer, or a file is declined.
_OTHERS = re.compile(r"cán bộ không thể|the officer cannot|the branch must decline|hồ sơ sẽ bị từ chối|từ chối xác nhận|trả lời thay")
_LEAD = re.compile(r"\A\s*(?:question|answer|câu hỏi|hỏi|trả lời|đáp|问题|回答|q|a)\s*[:：]\s*", re.I)


#: Sentences of refusals, labels of answers and placeholders, put in place of sound answers to validate the cutoffs (fixed values).
REFUSALS = ("Xin lỗi, tôi không thể trả lời câu hỏi này.", "Tôi chưa thể cung cấp nội dung đó.", "Chưa đủ thông tin để trả lời câu hỏi.", "Hệ thống không hỗ trợ loại câu hỏi này.",
            "I cannot answer this question.", "Sorry, I am not able to help with this.", "There is not enough information to answer.", "This is outside the scope of what I may say.",
            "抱歉,无法回答这个问题。", "Je ne peux pas répondre à cette question.", "Désolé, il est impossible de répondre.", "No answer can be given here.")
BLANKS = ("", "  ", "—", "N/A", "null", "**  **", "[E1]", "<p></p>", "...", "(no output)")


def words(text: str) -> list[str]:
    """Words without case, accents, citations, marks and labels."""
    plain = unicodedata.normalize("NFD", _LEAD.sub("", CITATION.sub(" ", text), 1).lower().replace("đ", "d"))
    plain = _MARKS.sub("", plain)
    return (_WORD_HAN if _HAN.search(plain) else _WORD).findall(plain)


class Read:
    """What several functions need of a text: its words, language and script, each read once."""

    def __init__(self, text: str):
        self.text, self.words = text, words(text)
        self.counts = Counter(self.words)
        self.codes = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16)
        _, self.letters, self.vietnamese, self.han = np.bincount(_KIND[self.codes], minlength=4).tolist()
        self.letters += self.vietnamese + self.han
        self.script = self._script()
        self.language, self.share = self._language()

    def _language(self) -> tuple[str | None, float]:
        """The language by function words (zh by script) and its share of the words that tell; None where too few tell."""
        if self.han >= 4 and self.han > 0.3 * len(self.words):
            return "zh", 1.0
        found = dict.fromkeys(FUNCTION_WORDS, 0)
        for w in self.counts.keys() & _TELLS.keys():
            for lang in _TELLS[w]:
                found[lang] += self.counts[w]
        if "'" in self.text or "’" in self.text:
            found["fr"] += sum(n for w, n in self.counts.items() if _ELIDED.match(w))
        best = max(found, key=found.get)
        return (best, found[best] / sum(found.values())) if found[best] >= 3 else (None, 0.0)

    def _script(self) -> str | None:
        """What the letters alone say: Han, Vietnamese letters, or neither (None for texts of under 20 letters)."""
        if self.han >= 4 and self.han > 0.3 * self.letters:
            return "zh"
        if self.letters < 20:
            return None
        return "vi" if self.vietnamese > 0.06 * self.letters else "latin"


def letters_of(texts: Iterable[str | None]) -> dict[tuple[str, bool], Counter]:
    """How often each character stands in the texts of a language, as they are and (True) without accents."""
    counts: dict[tuple[str, bool], Counter] = {}
    for t in texts:
        if t and (lang := Read(t).language):
            counts.setdefault((lang, False), Counter()).update(t.lower())
            counts.setdefault((lang, True), Counter()).update("".join(words(t)))
    return counts


def letter_counts(df: DataFrame, columns: list[str]) -> dict[tuple[str, bool], Counter]:
    """``letters_of`` over all texts of the columns; each task sums its batches, and what is collected has a row for each language and character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = letters_of(t for c in batch.columns for t in c.to_pylist())
            rows = [(lang, plain, ord(c), n) for (lang, plain), own in counts.items() for c, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.bool_(), pa.int32(), pa.int64()))],
                                             ["lang", "plain", "code", "n"])

    out: dict[tuple[str, bool], Counter] = {}
    for r in df.select(*columns).mapInArrow(run, "lang string, plain boolean, code int, n long").groupBy("lang", "plain", "code").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["lang"], r["plain"]), Counter())[chr(r["code"])] = r["n"]
    return out


class Letters:
    """Languages by the frequency of their letters, learnt from texts whose function words tell the language.

    A language is known by two distributions, of its texts as they are and without accents; the nearer one counts.
    """

    def __init__(self, texts: list[str] | None = None, counts: dict[tuple[str, bool], Counter] | None = None):
        counts = letters_of(texts or []) if counts is None else counts
        self.names = sorted({lang for lang, _ in counts})
        # a row for each character of the basic plane: its log frequency in each distribution (0 for what is no letter), and 1 for letters
        self.table = np.zeros((1 << 16, 2 * len(self.names) + 1), np.float32)
        alphabet = [c for c in range(1 << 16) if chr(c).isalpha()]
        self.table[alphabet, -1] = 1
        for (lang, plain), own in counts.items():
            column = 2 * self.names.index(lang) + plain
            total = sum(n for c, n in own.items() if c.isalpha()) + 500
            self.table[alphabet, column] = -math.log(total)
            for c, n in own.items():
                if c.isalpha() and c < "\uffff":
                    self.table[ord(c), column] = math.log((n + 1) / total)

    def language(self, read: Read) -> str | None:
        """The language that is clearly ahead; None where none is, or of short texts."""
        *score, letters = self.table.take(read.codes, axis=0).sum(0).tolist()
        if len(self.names) < 2 or letters < LEAST_LETTERS:
            return None
        by_language = [max(score[i : i + 2]) for i in range(0, len(score), 2)]
        second, first = sorted(by_language)[-2:]
        return self.names[by_language.index(first)] if first - second > AHEAD else None


@lru_cache(maxsize=4096)
def _asked(question: str) -> Read:
    return Read(question)


#: Parts of ``DECLINES`` of which every match contains one (fixed values).
_HINTS = ("không thể", "chưa thể", "không đủ", "chưa đủ", "không tìm thấy", "không hỗ trợ", "không có câu", "từ chối", "xin ", "nằm ngoài", "được phép", "ngoài ", "vượt ",
          "can", "could", "unable", "not able", "must decline", "won’t", "won't", "will not", "have to decline", "not have", "n't have", "n’t have", "found no", "may not", "not allowed",
          "not permitted", "no answer", "not enough", "insufficient", "too little", "outside", "not in a position", "not support", "n’t support", "n't support", "nothing",
          "not hold", "not contain", "not give", "无法", "不能", "抱歉", "拒绝", "je ne", "impossible", "désolé")


def _refusal(answer: str, size: int) -> list[int]:
    """For each family of sentences whether one of it declines (against it only where none does); and whether nothing of weight stands beside."""
    body = _LEAD.sub("", CITATION.sub(" ", answer)).strip().lower()
    if not any(hint in body for hint in _HINTS) or not DECLINES.search(body):
        return [-1, -1, -1, -1 if size > 24 else 0]
    sentences = [s for s in re.split(r"(?<=[.!?;])\s+|(?<=[。！？；])|\n+", body) if s.strip()]
    declining = [bool(DECLINES.search(s)) and not _OTHERS.search(s) for s in sentences]
    sizes = [len((_WORD_HAN if _HAN.search(s) else _WORD).findall(s)) for s in sentences]
    first = next((i for i, d in enumerate(declining) if d), None)
    families = [1 if f.search(body) else 0 for f in _FAMILIES]
    if first is None:  # somebody else declines, or a file is declined
        return [*families, -1]
    own = sum(n for n, d in zip(sizes, declining) if d)
    beside = [n for n, d in zip(sizes, declining) if not d]
    small = sum(sizes[:first]) <= own and sum(beside) <= 4 * own and max(beside, default=0) <= 2 * max(own, 11)
    return [*families, 1 if small else -1]


def _copy(asked: Read, said: Read, cited: bool) -> list[int]:
    if not asked.words or not said.words:
        return [-1, 0, 0, 0, 0]
    both = sum((asked.counts & said.counts).values())
    whole = both == len(said.words) == len(asked.words)
    same = whole or len(asked.words) > 2 and both >= 0.85 * len(said.words) and both >= 0.6 * len(asked.words)
    order = 0.0
    if both >= 0.3 * len(said.words):  # with fewer words in common the order has even less
        pairs = set(zip(asked.words, asked.words[1:]))
        order = sum(p in pairs for p in zip(said.words, said.words[1:])) / max(1, len(said.words) - 1)
    marked = said.text.rstrip(" \"”»'’*_)").endswith(("?", "？"))
    return [1 if same else -1, 1 if order >= 0.7 else -1 if order < 0.3 else 0, 1 if 0.7 <= len(said.words) / len(asked.words) <= 1.4 else -1,
            1 if marked else -1, -1 if cited else 1]


def _language(asked: Read, said: Read, by_letters: tuple[str | None, str | None]) -> list[int]:
    known = asked.language is not None and said.language is not None
    by_words = 0 if not known else 1 if asked.language != said.language and said.share > 0.6 else -1
    a, b = asked.script, said.script
    # Latin letters alone speak neither for nor against: several languages have them, and Vietnamese without accents too
    by_script = 0 if a is None or b is None or b == "latin" and a != "zh" else 1 if a != b else -1
    q, x = by_letters
    letters = 0 if q is None or x is None else 1 if q != x else -1
    content = {w for w in said.counts if len(w) > 2 and w.isalpha()}  # shorter ones stand in many languages
    shared = len(content & asked.counts.keys())
    return [by_words, by_script, letters, 0 if len(content) < 8 else 1 if shared == 0 else -1 if shared > 2 else 0]


def _nothing(answer: str | None) -> list[int]:
    """No letter or digit is there; all that is there is a placeholder; all that is there is markup."""
    if not answer or not answer.strip():
        return [1, 0, 0]
    if len(answer) > 200:
        return [-1, -1, 0]
    left = sum(map(str.isalnum, CITATION.sub("", answer)))
    placeholder = PLACEHOLDER.fullmatch(answer.strip()) or PLACEHOLDER.fullmatch(MARKUP.sub(" ", answer))
    markup = left and ("<" in answer or "&" in answer or "```" in answer) and not MARKUP.sub("", answer)
    return [1 if not left else -1 if left > 20 else 0, 1 if left and placeholder else -1 if left else 0, 1 if markup else 0]


def _counted(tokens: int | None) -> int:
    return 0 if tokens is None or tokens in (2, 3) else 1 if tokens < 2 else -1


def votes(question: str | None, answer: str | None, abstained: bool | None, error: str | None, tokens: int | None, letters: Letters, full: bool) -> list[int]:
    """The votes of all functions but those of ``truncated``, in the order of ``FUNCTIONS``; ``full``: the answer has content."""
    failed = 1 if error else 0
    if not full:  # what isn't there neither refuses nor copies nor has a language
        return [*_nothing(answer), _counted(tokens), failed] + [-1] * (len(ANSWERED) - 5)
    said, cited = Read(answer), CITATION.search(answer) is not None
    size = len(said.words)
    out = [*_nothing(answer), _counted(tokens), failed, *_refusal(answer, size)]
    out += [0 if abstained is None else 1 if abstained else -1, 1 if size <= 30 else -1 if size > 60 else 0, -1 if cited else 1]
    if not question or not question.strip():
        return out + [-1, 0, 0, 0, 0, -1, 0, 0, 0]
    asked = _asked(question)
    return out + _copy(asked, said, cited) + _language(asked, said, (_by_letters(letters, question), letters.language(said)))


_QUESTIONS: dict[tuple[int, str], str | None] = {}


def _by_letters(letters: Letters, question: str) -> str | None:
    key = (id(letters), question)
    if key not in _QUESTIONS:
        if len(_QUESTIONS) > 4096:
            _QUESTIONS.clear()
        _QUESTIONS[key] = letters.language(_asked(question))
    return _QUESTIONS[key]


def open_votes(answer: str | None, full: bool) -> tuple[int, int]:
    """(no mark closes the text, its brackets and emphasis are not balanced)."""
    if not full:
        return -1, -1
    text = answer.rstrip()
    open_end = 1 if text[-1].isalnum() or text[-1] in "�,[(-–•" else -1
    odd = text.count("(") != text.count(")") or text.count("[") != text.count("]") or text.count("**") % 2 == 1 or text.count("“") != text.count("”")
    return open_end, 1 if odd else -1


#: The functions whose votes come from the pair alone, in order.
ANSWERED = [f"{d}_{f}" for d, fs in FUNCTIONS.items() if d != "truncated" for f in fs]


def all_patterns(k: int) -> np.ndarray:
    return np.array([[c // 3**i % 3 - 1 for i in range(k)] for c in range(3**k)])


def _posterior(patterns: np.ndarray, right: np.ndarray, prior: float, strength: np.ndarray) -> np.ndarray:
    log = np.zeros((len(patterns), 2))
    for y, sign in ((1, 1), (0, -1)):
        for i in range(patterns.shape[1]):
            log[:, y] += strength[i] * np.where(patterns[:, i] == sign, np.log(right[i, y]), np.where(patterns[:, i] == -sign, np.log1p(-right[i, y]), 0.0))
    odds = np.log(prior / (1 - prior)) + log[:, 1] - log[:, 0]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def strengths(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
    """How much each function counts: less, the more its votes go with those of others among pairs of the same kind.

    Of each two functions the correlation within the defective and within the sound pairs is taken, each kind weighing the
    same; what it shares with others is divided among them.
    """
    k = patterns.shape[1]
    shared = np.zeros((k, k))
    for mass in (counts * post, counts * (1 - post)):
        if mass.sum() < 1:
            continue
        v = patterns - (patterns * mass[:, None]).sum(0) / mass.sum()
        cov = (v * mass[:, None]).T @ v / mass.sum()
        deviation = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        shared += np.where(np.outer(deviation, deviation) > 1e-4, cov / np.outer(deviation, deviation), 0) / 2
    np.fill_diagonal(shared, 0)
    return 1 / (1 + np.maximum(shared, 0).sum(1))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The posterior of a defect for each vote pattern of its functions: EM over the counts of the patterns.

    Each function is right with a probability of its own, learnt separately for pairs with and without the defect;
    abstaining carries no evidence. EM runs twice: first as if the functions were independent, then with their strengths.
    """
    k = patterns.shape[1]
    strength = np.ones(k)
    for _ in range(2):
        right = np.full((k, 2), BELIEF)  # right[i, y]: the function votes as y says
        prior = 0.05
        for _ in range(rounds):
            post = _posterior(patterns, right, prior, strength)
            mass = np.stack([counts * (1 - post), counts * post], axis=1)
            prior = float(np.clip((mass[:, 1].sum() + 1) / (counts.sum() + 20), LEAST_PRIOR, 0.5))
            for i in range(k):
                for y, sign in ((1, 1), (0, -1)):
                    spoke = mass[patterns[:, i] != 0, y].sum()
                    agreed = mass[patterns[:, i] == sign, y].sum()
                    right[i, y] = np.clip((agreed + BELIEF * BELIEF_ROWS) / (spoke + BELIEF_ROWS), 0.01, 0.999)
        strength = strengths(patterns, counts, post)
    return post


def f1(chosen: np.ndarray, true: np.ndarray, share: float = 0.5, counts: np.ndarray | None = None) -> float:
    """F1 on labelled pairs (``counts`` of each), as if a share of ``share`` of all pairs were defective."""
    if not true.any():
        return 0.0
    n = np.ones(len(true)) if counts is None else counts
    hit, false = share * n[chosen & true].sum() / n[true].sum(), (1 - share) * n[chosen & ~true].sum() / max(1, n[~true].sum())
    return float(2 * hit / max(1e-12, hit + false + share))


def cutoff(post: np.ndarray, true: np.ndarray, share: float = 0.5, counts: np.ndarray | None = None) -> float:
    """The cutoff with the best F1 on labelled pairs: midway (in log odds) between the last posterior taken and the next below."""
    if not true.any():
        return 0.5
    values = np.unique(post)
    scores = np.array([f1(post >= v, true, share, counts) for v in values])
    best = int(np.flatnonzero(scores >= scores.max() - 1e-9)[0])
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    middle = (odds(values[best]) + odds(values[best - 1])) / 2 if best else odds(values[0]) - 1
    return float(min(0.95, 1 / (1 + math.exp(-middle))))


def plant(rows: list[tuple], letters: Letters) -> list[tuple[str, tuple]]:
    """(defect or "sound", pair) of sound pairs and of each with every defect planted; ``rows`` are (question, answer, flags ...)."""
    out = []
    languages = [_by_letters(letters, r[0]) if r[0] else None for r in rows]
    nearest: dict[str, int] = {}  # of each language the next row with it, round the end
    swapped: list[int | None] = [None] * len(rows)
    for j in range(2 * len(rows) - 1, -1, -1):
        if lang := languages[n := j % len(rows)]:
            if j < len(rows):
                swapped[n] = min((at for other, at in nearest.items() if other != lang), default=None)
            nearest[lang] = j
    for n, (question, answer, *flags) in enumerate(rows):
        out.append(("sound", (question, answer, *flags)))
        out.append(("empty", (question, BLANKS[n % len(BLANKS)], *flags)))
        inner = [m.start() for m in re.finditer(r"(?<=\w)[ \w](?=\w)", answer)]
        if inner:
            out.append(("truncated", (question, answer[: inner[len(inner) * (30 + n * 37 % 65) // 100] + (n % 2)].rstrip(" .,;:"), *flags)))
        refusal = REFUSALS[n % len(REFUSALS)]
        out.append(("refusal", (question, refusal if n % 3 else f"{answer.split(',')[0][:30]}, {refusal[0].lower()}{refusal[1:]}", *flags)))
        if question and len(words(question)) > 2:
            out.append(("copy", (question, (question, question.upper(), question.rstrip("?？. "), f"“{question}”")[n % 4], *flags)))
        if swapped[n] is not None:
            out.append(("other_language", (question, rows[swapped[n] % len(rows)][1], *flags)))
    return out


def patterns_of(pairs: list[tuple], letters: Letters) -> dict[str, np.ndarray]:
    """For each defect the number of the vote pattern of each pair, without what only the whole table tells (limits)."""
    codes: dict[str, list[int]] = {d: [] for d in FUNCTIONS}
    for question, answer, abstained, error, tokens in pairs:
        kind = ending(answer, question)[0]
        each = dict(zip(ANSWERED, votes(question, answer, abstained, error, tokens, letters, kind != "empty")))
        open_end, odd = open_votes(answer, kind != "empty")
        each |= {"truncated_judged": 1 if kind in ("torn", "prose") else -1 if kind in ("whole", "empty") else 0, "truncated_open_end": open_end, "truncated_unbalanced": odd,
                 "truncated_beyond_limit": 1 if tokens is not None and tokens > 12 + len(answer) * 0.7 else -1, "truncated_broken_off": 1 if error and kind != "empty" else 0}
        for d, fs in FUNCTIONS.items():
            codes[d].append(sum((each[f"{d}_{f}"] + 1) * 3**i for i, f in enumerate(fs)))
    return {d: np.array(c, int) for d, c in codes.items()}


def vote(df: DataFrame, id_col: str, columns: dict[str, str], letters: Broadcast) -> DataFrame:
    """``id`` and for each defect the number of its vote pattern; one row for each row of ``df``."""

    def also(read: dict[str, list]) -> list[pa.Array]:
        each = [votes(q, a, b, e, t, letters.value, kind != "empty") + list(open_votes(a, kind != "empty"))
                for q, a, b, e, t, kind in zip(*(read[c] for c in ("question", "text", "abstained", "error", "tokens", "ending")))]
        by_function = zip(*each) if each else [()] * (len(ANSWERED) + 2)
        return [pa.array(v, pa.int8()) for v in by_function] + [pa.array([bool(e) for e in read["error"]])]

    schema = ", ".join(f"{n} tinyint" for n in [*ANSWERED, "truncated_open_end", "truncated_unbalanced"]) + ", errs boolean"
    texts = read_texts(df, {"id": id_col, "text": columns["answer"], "source": columns["source"], "model": columns["model"], "tokens": columns["tokens"],
                            "question": columns["question"], "abstained": columns["abstained"], "error": columns["error"]}, also, schema)
    judged = judge(df, columns["answer"], texts)
    say = lambda yes, no: F.when(yes, 1).otherwise(no)
    judged = judged.withColumns({
        "truncated_judged": say(F.col("posterior") >= 0.5, -1), "truncated_beyond_limit": say((F.col("at_limit") > 0) | F.col("excess"), -1),
        "truncated_broken_off": say(F.col("errs") & (F.col("ending") != "empty"), 0)})
    return judged.select("id", *(sum((F.col(f"{d}_{f}").cast("int") + 1) * 3**i for i, f in enumerate(fs)).alias(d) for d, fs in FUNCTIONS.items()))


def find_defects(df: DataFrame, id_col: str, *, question: str, answer: str, abstained: str, error: str, tokens: str, source: str,
                 model: str) -> DataFrame:
    """``id, defects``: each pair with at least one defect, and its defects as (defect_type, posterior) in the order of ``PRECEDENCE``.

    A pair may have several: every defect whose posterior reaches its validated cutoff. Null, blank and placeholder answers are
    empty and nothing else. A null or blank question leaves copy and other_language undecided (no defect). Repeated deliveries
    are rows of their own, and so are rows with the same or a null id. An empty table gives none; other columns are ignored.

    Only bounded tables reach the driver: the counts of at most 2,187 vote patterns of each defect, those of its planted and of the
    sound pairs, and the counts of the characters of each language. All are taken over the whole table.
    """
    spark = df.sparkSession
    columns = {"question": question, "answer": answer, "abstained": abstained, "error": error, "tokens": tokens, "source": source, "model": model}
    letters = spark.sparkContext.broadcast(Letters(counts=letter_counts(df, [question, answer])))
    voted = vote(df, id_col, columns, letters).checkpoint()
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("defect_type"), F.col(d).alias("pattern")) for d in FUNCTIONS)))
    counts = voted.select(each.alias("v")).groupBy("v.defect_type", "v.pattern").count().collect()  # at most 2 * 2187 rows with the others
    post, share = {}, {}
    for d, fs in FUNCTIONS.items():
        n = np.zeros(3 ** len(fs))
        for r in counts:
            if r["defect_type"] == d:
                n[r["pattern"]] = r["count"]
        patterns = all_patterns(len(fs))
        post[d] = np.where((patterns[:, : FOUND_IN_TEXT[d]] == 1).any(1), fit(patterns, n), 0.0)
        share[d] = float(np.clip((n * post[d]).sum() / max(1.0, n.sum()), LEAST_PRIOR, 0.5))

    at = validated(planted_counts(df, columns, letters, post), post, share)
    found = [F.when(F.element_at(F.lit(post[d]), F.col(d) + 1) >= at[d], F.struct(F.lit(d).alias("defect_type"), F.round(F.element_at(F.lit(post[d]), F.col(d) + 1), 6).alias("posterior")))
             for d in PRECEDENCE]
    return voted.select("id", F.array_compact(F.array(*found)).alias("defects")).where(F.size("defects") > 0)


def planted_counts(df: DataFrame, columns: dict[str, str], letters: Broadcast, post: dict[str, np.ndarray]) -> list[tuple[str, bool, int, int]]:
    """(defect, planted, pattern, pairs): the vote patterns of all sound pairs, and of the same with the defect planted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, codes = labelled(list(zip(*(c.to_pylist() for c in batch.columns))), letters.value, post)
            seen = Counter((d, label == d, code) for d in FUNCTIONS for label, code in zip(labels, codes[d].tolist()) if label in (d, "sound"))
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.bool_(), pa.int32(), pa.int64()))],
                                             ["defect", "planted", "pattern", "n"])

    flags = df.select(*(F.col(columns[k]).cast("long" if k == "tokens" else "string" if k in ("question", "answer", "error") else "boolean").alias(k)
                        for k in ("question", "answer", "abstained", "error", "tokens")))
    counts = flags.mapInArrow(run, "defect string, planted boolean, pattern int, n long").groupBy("defect", "planted", "pattern").agg(F.sum("n"))
    return [tuple(r) for r in counts.collect()]  # at most 2,187 patterns of a defect, twice


def validated(counts: list[tuple[str, bool, int, int]], post: dict[str, np.ndarray], share: dict[str, float]) -> dict[str, float]:
    """The cutoff of each defect, on sound pairs and the same with defects planted (``planted_counts``), as rare as EM found them."""
    at = {}
    for d in FUNCTIONS:
        own = sorted(r[1:] for r in counts if r[0] == d)
        planted, pattern, n = (np.array([r[i] for r in own], kind) for i, kind in enumerate((bool, int, float)))
        at[d] = cutoff(post[d][pattern], planted, share[d], n)
    return at


def labelled(rows: list[tuple], letters: Letters, post: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Labels and vote patterns of the sound and the planted pairs, of those ``rows`` that have content and for which no posterior reaches a half."""
    rows = [r for r in rows if has_content(r[1])]
    codes = patterns_of(rows, letters)
    sound = np.flatnonzero(np.all([post[d][codes[d]] < 0.5 for d in FUNCTIONS], axis=0))
    planted = [x for x in plant([rows[i] for i in sound], letters) if x[0] != "sound"]
    more = patterns_of([pair for _, pair in planted], letters)
    return (np.array(["sound"] * len(sound) + [label for label, _ in planted], dtype=object), {d: np.concatenate([codes[d][sound], more[d]]) for d in FUNCTIONS})


def labels_of(found: DataFrame) -> DataFrame:
    """``id, defect_type, posterior``: one row for each defect of a pair."""
    return found.select("id", F.explode("defects").alias("d")).select("id", "d.defect_type", "d.posterior")


def one_type(found: DataFrame) -> DataFrame:
    """``id, defect_type``: of each pair the first of its defects in the order of ``PRECEDENCE``."""
    return found.select("id", F.element_at("defects", 1)["defect_type"].alias("defect_type"))
