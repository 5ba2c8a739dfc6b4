import numpy as np
import pytest

from quillstone.llm import pair_defects as pd_
from quillstone.llm import truncation as tr
from tests.conftest import rows

SCHEMA = "trace_id long, source string, question string, answer string, abstained boolean, error string, tokens int, model string, source_id int"
COLUMNS = {"question": "question", "answer": "answer", "abstained": "abstained", "error": "error", "tokens": "tokens", "source": "source", "model": "model"}
QUESTION = "Điều kiện để bàn giao hợp đồng đầu ra đối với ngành da giày gồm những nội dung nào?"
GOOD = "Căn cứ [E1], bên vay phải bàn giao hợp đồng đầu ra cho chi nhánh trước ngày giải ngân và gửi kết quả cho phòng pháp chế [E2]."


def pairs(spark, answers, question=QUESTION):
    base = [(i, "s", question, a, None, None, None, None, i) for i, a in enumerate(answers)]
    filler = [(1000 + i, "s", question, GOOD, False, None, 40, "m", i) for i in range(120)]
    return spark.createDataFrame(base + filler, SCHEMA)


def found(spark, answers, question=QUESTION):
    got = pd_.one_type(pd_.find_defects(pairs(spark, answers, question), "trace_id", **COLUMNS))
    return {r.id: r.defect_type for r in got.collect()}


@pytest.mark.parametrize("text", [None, "", "  \n​", "—", "**  **", "N/A", "null", "Answer:", "<p></p>", "[E1][E2]", "```\n```", "<think></think>", "(no output)"])
def test_nothing_is_empty(text):
    assert not tr.has_content(text)


@pytest.mark.parametrize("text", ["Có [E1].", "12,50%", "No.", "- a", "不", GOOD])
def test_short_answers_have_content(text):
    assert tr.has_content(text)


def test_each_defect(spark):
    answers = [None, "—", GOOD, QUESTION, QUESTION.upper().rstrip("?"), "Xin lỗi, tôi không thể trả lời câu hỏi này.",
               "According to the passages, the lending branch must hand over the offtake contract before the loan is paid out for the first time.",
               "Căn cứ [E1], bên vay phải bàn giao hợp đồng đầu ra cho chi nhánh trước ngày giải ng", "Có [E1].",
               "can cu [E1], ben vay phai ban giao hop dong dau ra cho chi nhanh truoc ngay giai ngan va gui ket qua cho phong phap che.",
               GOOD + " Tuy nhiên chưa đủ thông tin về thời hạn áp dụng cụ thể.", "如果余额超过预警线,二级审批人需要暂停内部评级表,并且延期还款计划 [E1]。"]
    assert found(spark, answers) == {0: "empty", 1: "empty", 3: "copy", 4: "copy", 5: "refusal", 6: "other_language", 7: "truncated", 11: "other_language"}


def test_null_question_and_clashing_columns(spark):
    got = found(spark, [QUESTION, "Sorry, I cannot answer that question.", None], None)
    assert got == {1: "refusal", 2: "empty"}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pd_.find_defects(empty, "trace_id", **COLUMNS).count() == 0
    cut = tr.find_truncated(empty, "trace_id", "answer", source="source", model="model", tokens="tokens")
    assert cut.count() == 0 and tr.truncation_by_source(cut).count() == 0 and tr.hidden_limits(empty, "source", "answer").count() == 0


def test_repeated_deliveries_are_rows_of_their_own(spark):
    df = pairs(spark, ["—", "—"]).unionByName(pairs(spark, []).where("trace_id < 0"))
    assert rows(pd_.one_type(pd_.find_defects(df, "trace_id", **COLUMNS))) == [(0, "empty"), (1, "empty")]


def test_null_and_repeated_ids_keep_their_rows(spark):
    base = [(None, "s", QUESTION, "—", None, None, None, None, i) for i in range(3)] + [(7, "s", QUESTION, a, None, None, None, None, 9) for a in ("—", "", QUESTION, GOOD, None)]
    filler = [(1000 + i, "s", QUESTION, GOOD, False, None, 40, "m", i) for i in range(120)]
    got = rows(pd_.one_type(pd_.find_defects(spark.createDataFrame(base + filler, SCHEMA), "trace_id", **COLUMNS)))
    assert got == sorted([(None, "empty")] * 3 + [(7, "empty")] * 3 + [(7, "copy")], key=repr)


def drawn(accuracies, n=20_000, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.1
    vote = lambda right: np.where(rng.random(n) < right, truth, ~truth) * 2 - 1
    return truth, [vote(a) for a in accuracies], rng


def test_the_model_learns_which_function_is_right():
    truth, seen, _ = drawn((0.6, 0.95, 0.9, 0.85))
    code = sum((v + 1) * 3**i for i, v in enumerate(seen))
    post = pd_.fit(pd_.all_patterns(4), np.bincount(code, minlength=81).astype(float))
    model, first, majority = ((post[code] > 0.5) == truth).mean(), ((seen[0] > 0) == truth).mean(), ((sum(seen) > 0) == truth).mean()
    assert model > 0.97 and model > majority and model > first


def test_copies_of_a_signal_count_for_less():
    truth, seen, rng = drawn((0.8, 0.92, 0.92))
    copies = [np.where(rng.random(len(truth)) < 0.98, seen[0], -seen[0]) for _ in range(2)]
    seen = [seen[0], *copies, *seen[1:]]
    patterns, code = pd_.all_patterns(5), sum((v + 1) * 3**i for i, v in enumerate(seen))
    counts = np.bincount(code, minlength=243).astype(float)
    strength = pd_.strengths(patterns, counts, np.bincount(code, truth, 243) / np.maximum(counts, 1))
    assert strength[:3].max() < 0.5 and strength[3:].min() > 0.9


def test_cutoffs_are_validated_on_labelled_rows():
    post, true = np.array([0.9, 0.85, 0.8, 0.6, 0.55, 0.1]), np.array([True, True, True, False, False, False])
    assert 0.6 < pd_.cutoff(post, true) <= 0.8 and pd_.cutoff(post / 4, true) < 0.25
    assert pd_.cutoff(np.empty(0), np.empty(0, bool)) == 0.5


def test_planted_defects_are_found():
    questions = [QUESTION, "Who has to file the tax report if the deal is cancelled?"]
    answers = [GOOD, "The lending branch must file the tax report in the core system before the loan is paid out, unless the reviewer has objected [E2]."]
    pool = [(questions[i % 2], answers[i % 2], False, None, 40) for i in range(20)]
    letters = pd_.Letters([t for r in pool for t in r[:2]])
    labels, pairs_ = zip(*pd_.plant(pool, letters))
    codes = pd_.patterns_of(pairs_, letters)
    patterns = {d: pd_.all_patterns(len(fs))[codes[d]] for d, fs in pd_.FUNCTIONS.items()}
    evidence = {"empty": slice(0, 3), "refusal": slice(0, 3), "copy": slice(0, 1), "other_language": slice(0, 1)}  # the functions that read the text itself
    for d, some in evidence.items():
        own = np.array([label == d for label in labels])
        assert own.sum() == 20 and (patterns[d][own][:, some] == 1).any(1).all() and (patterns[d][[label == "sound" for label in labels]][:, some] < 1).all()


def test_letters_and_cutoffs_are_learnt_from_all_rows(spark):
    english = "The lending branch must file the tax report in the core system before the loan is paid out, unless the reviewer has objected [E2]."
    data = [(i, QUESTION if i % 2 else "Who has to file the tax report if the deal is cancelled?", f"{GOOD if i % 2 else english} {i}.", False, None, 40) for i in range(1200)]
    df = spark.createDataFrame(data, "trace_id long, question string, answer string, abstained boolean, error string, tokens int").repartition(3)
    counts = pd_.letter_counts(df, ["question", "answer"])
    assert counts == pd_.letters_of([t for r in data for t in r[1:3]])
    none = {d: np.zeros(3 ** len(fs)) for d, fs in pd_.FUNCTIONS.items()}
    letters = spark.sparkContext.broadcast(pd_.Letters(counts=counts))
    planted = pd_.planted_counts(df, {k: k for k in ("question", "answer", "abstained", "error", "tokens")}, letters, none)
    for d in pd_.FUNCTIONS:
        assert [sum(n for defect, own, _, n in planted if defect == d and own is y) for y in (False, True)] == [1200, 1200], d


@pytest.mark.parametrize("text, kind", [
    ("Một câu trọn vẹn.", "whole"), ("A whole sentence [E1]", "whole"), ("A sentence that [E", "torn"), ("Một câu bị c�", "torn"), ("one, two,", "torn"),
    ("Tóm tắt: bên vay phải bàn giao hợp", "prose"), ("Căn cứ [E1]", "torn"), ("55 ngày làm việc", "phrase"), ("- một\n- hai", "list"), ("The sum is 18.", "number"), ("It ends on 05/06/2020.", "whole"), ("The sum is 1.200.", "number"),
    ("(see the annex", "torn"), (None, "empty"), ("—", "empty"), ("词语还没有说完", "prose"), ("一句话。", "whole")])
def test_endings(text, kind):
    assert tr.ending(text)[0] == kind


def test_hidden_limits_come_to_light(spark):
    rng = np.random.default_rng(1)
    texts = ["đ" * 10 + "x" * int(n) for n in rng.integers(90, 400, 300)]
    cut = [t[:240] + str(1000000000 + i) for i, t in enumerate(texts) if len(t) > 250] + [t for t in texts if len(t) <= 250]
    data = [("plain", t) for t in texts] + [("chars", t) for t in cut] + [("copies", texts[0])] * 50 + [("bytes", (str(100 + i) + t).encode()[:300].decode(errors="ignore")) for i, t in enumerate(texts)] + [(None, None)]
    limits = {(r.source, r.measure, r.limit) for r in tr.hidden_limits(spark.createDataFrame(data, "s string, t string"), "s", "t").collect()}
    assert ("chars", "characters", 250) in limits and ("bytes", "utf8", 300) in limits and not [x for x in limits if x[0] in ("plain", "copies")]


def test_limits_decide_what_endings_leave_open(spark):
    """Bare lists in two sources; one cuts at 120 characters. Only its limit tells its lists from whole ones."""
    rng = np.random.default_rng(3)
    words = ["report", "deed", "ledger", "figure", "notice", "permit", "margin", "annex"]
    line = lambda: "- the " + words[rng.integers(8)] + " " + words[rng.integers(8)] + " of " + words[rng.integers(8)]
    whole = [("open", "List:\n" + "\n".join(line() for _ in range(rng.integers(2, 9)))) for _ in range(400)]
    short = [("short", t[:120].rstrip()) for _, t in whole]
    prose = [("open", f"The {words[rng.integers(8)]} is due. It names the {words[rng.integers(8)]} and the {words[rng.integers(8)]}.") for _ in range(200)]
    df = spark.createDataFrame([(i, s, t, None, None) for i, (s, t) in enumerate(whole + short + prose)], "id long, source string, answer string, tokens int, model string")
    full = dict(enumerate([t for _, t in whole] * 2))
    score = {}
    for limits in (True, False):
        found = {r.id for r in tr.find_truncated(df, "id", "answer", source="source", model="model", tokens="tokens", limits=limits).where("truncated").collect()}
        true = {i for i in range(400, 800) if short[i - 400][1] != full[i]}
        score[limits] = 2 * len(found & true) / (len(found) + len(true))
    assert score[True] > 0.85 and score[True] > score[False] + 0.3, score


def test_measures():
    import html
    import json

    for t in ["a\nb\r\nc", 'x<y>&"z', "é🏦ộ\t\\", "plain"]:
        r = dict(zip(tr.MEASURES, tr.measures(t)))
        assert r["characters"] == len(t) and r["utf8"] == len(t.encode()) and r["utf16"] == len(t.encode("utf-16-le")) // 2
        assert r["crlf"] == len(t.replace("\r\n", "\n").replace("\n", "\r\n")) and r["html"] == len(html.escape(t, quote=False).replace('"', "&quot;"))
        assert r["json"] == len(json.dumps(t)) - 2 and r["json_utf8"] == len(json.dumps(t, ensure_ascii=False).encode()) - 2


def test_very_long_answer(spark):
    got = found(spark, [GOOD * 2000, (GOOD * 2000)[:-3]])
    assert got == {1: "truncated"}
