"""Column functions of the domain."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of signals, combined signals and capitalisation buckets.
SIGNAL_LABELS = {"bullish": "매수", "bearish": "매도", "neutral": "중립"}
STATUS_COLOURS = {"COMPLETE": "green", "IN_PROGRESS": "amber", "ERROR": "red", "IDLE": "gray"}
SIGNAL_COLOURS = {"BULLISH": "green", "BEARISH": "red", "NEUTRAL": "primary"}
ACTION_COLOURS = {"BUY": "green", "COVER": "green", "SELL": "red", "SHORT": "red", "HOLD": "primary"}
#: Fixed value: a sentence ends with its marks and the space after them; a point before digits ends none.
SENTENCE = r"[^.!?]+(?:\.\d+[^.!?]*|[.!?]+\s*)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def investor_signal(score: Column | str) -> Column:
    s = F.coalesce(_c(score), F.lit(0.0))
    return F.when(s >= 7, "bullish").when(s <= 3, "bearish").otherwise("neutral")


def investor_confidence(score: Column | str) -> Column:
    """Half-even rounding; a missing score counts as 0."""
    s = F.coalesce(_c(score), F.lit(0.0))
    bull = F.least(F.lit(95.0), F.bround(60 + (s - 7) / 3 * 35))
    bear = F.least(F.lit(90.0), F.bround(60 + (3 - s) / 3 * 30))
    return F.when(s >= 7, bull).when(s <= 3, bear).otherwise(F.bround(55 + F.abs(s - 5) * 4))


def adjusted_score(signal: Column | str, confidence: Column | str) -> Column:
    return F.when(_c(signal) == "bullish", _c(confidence)).when(_c(signal) == "bearish", 100 - _c(confidence)).otherwise(F.lit(50.0))


def combined_signal(bullish: Column | str, bearish: Column | str, evaluators: int = 3) -> Column:
    return F.when(_c(bullish) == evaluators, "strong_buy").when(_c(bullish) >= 2, "buy").when(_c(bearish) >= 2, "sell").otherwise("hold")


def cap_bucket(value: Column | str) -> Column:
    """Of a capitalisation in billions of dollars."""
    v = _c(value)
    return F.when(v > 200, "mega").when(v > 10, "large").when(v > 2, "mid").otherwise("small")


def label(key: Column | str, labels: dict[str, str], other: str | None = None) -> Column:
    """The label of a key; of one without a label, itself or ``other``."""
    mapping = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(mapping, _c(key)), _c(key) if other is None else F.lit(other))


def percent_text(x: Column | str, signed: bool = False) -> Column:
    """One decimal, or N/A; rounded half-even first, as the formatter would round up."""
    text = F.format_string("%+.1f%%" if signed else "%.1f%%", F.bround(_c(x), 1))  # of null it makes the word null
    return F.when(_c(x).isNull(), "N/A").otherwise(text)


def clean_warning(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "^⚠️\\s*", "")


def base_agent_key(node_id: Column | str) -> Column:
    """A node id without its six-character suffix."""
    return F.regexp_replace(_c(node_id), "_[a-z0-9]{6}$", "")


def display_name(node_id: Column | str) -> Column:
    """Words of a node id in title case, without the agent mark and an id of five characters or more with a digit."""
    plain = F.regexp_replace(F.regexp_replace(_c(node_id), "_[A-Za-z]*[0-9][A-Za-z0-9]{3,}$", ""), "_agent$", "")
    return F.initcap(F.replace(plain, F.lit("_"), F.lit(" ")))


def risk_manager_id(manager: Column | str) -> Column:
    return F.concat(F.lit("risk_management_agent_"), F.element_at(F.split(_c(manager), "_"), -1))


def ticker_list(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), ","), lambda t: F.trim(t)), lambda t: t != "")


def currency(text: Column | str, default: float = 100000.0) -> Column:
    number = F.regexp_replace(_c(text), "[^0-9.]", "").try_cast("double")
    return F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(default))


def parse_decisions(text: Column | str) -> Column:
    """A decision map; text that isn't one gives an empty map, so that the run goes on."""
    kind = "map<string, struct<action: string, quantity: double, confidence: double, reasoning: string>>"
    return F.coalesce(F.from_json(_c(text), kind), F.create_map().cast(kind))


def is_json(text: Column | str) -> Column:
    """Whether text is JSON, with NaN, Infinity and undefined allowed."""
    mended = F.regexp_replace(_c(text), "\\b(NaN|undefined|-?Infinity)\\b", "null")
    return F.try_parse_json(mended).isNotNull()


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(text: Column | str) -> Column:
    """A text in short paragraphs: its lines, each in groups of two or three sentences.

    Two sentences are a group if the second ends with a point and one space, and no digit
    before them; else three are. What follows a line's last sentence mark is left out, but a
    line without any is one sentence. Blank lines and null texts give nothing.
    """
    group = "named_struct('done', cast(array() as array<string>), 'open', '', 'n', 0)"

    def of_line(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(SENTENCE), 0)
        whole = F.when(F.size(found) == 0, F.array(line)).otherwise(found)
        return F.aggregate(whole, F.expr(group), grown, lambda s: F.array_append(s["done"], s["open"]))

    def grown(s: Column, x: Column) -> Column:
        end = (s["n"] == 2) | ((s["n"] == 1) & x.endswith(". ") & ~x.rlike(r"[0-9]\.\s*$"))
        both = F.concat(s["open"], x)
        return F.struct(F.when(end, F.array_append(s["done"], both)).otherwise(s["done"]).alias("done"), F.when(end, "").otherwise(both).alias("open"), F.when(end, 0).otherwise(s["n"] + 1).alias("n"))

    lines = F.filter(F.split(_c(text), "\n"), lambda line: line.rlike(r"\S"))
    return F.filter(F.transform(F.flatten(F.transform(lines, of_line)), _trimmed), lambda p: p != "")


def clock_text(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "h:mm:ss a")


def confidence_badge(x: Column | str) -> Column:
    return F.when(_c(x) >= 50, "success").when(_c(x) >= 0, "warning").otherwise("outline")


def progress_percent(done: Column | str, total: Column | str) -> Column:
    return F.coalesce(F.try_divide(_c(done) * 100.0, _c(total)), F.lit(0.0))


def number_text(x: Column | str) -> Column:
    """One decimal, or N/A."""
    return F.when(_c(x).isNull(), "N/A").otherwise(F.format_string("%.1f", F.bround(_c(x), 1)))


def reasoning(investor: Column | str, signal: Column | str, score: Column | str) -> Column:
    """A sentence for a signal; a missing score counts as 0."""
    verdict = F.when(_c(signal) == "bullish", "convincing").when(_c(signal) == "bearish", "not convincing").otherwise("mixed")
    return F.format_string("%s: %s at %.1f of 10", _c(investor), verdict, F.bround(F.coalesce(_c(score), F.lit(0.0)), 1))


#: The sentences by investor and signal; {name} is a figure, {factors} the first two factors.
REASONS = {
    ("buffett", "bullish"): "ROE {roe}와 품질 지표가 강해 경제적 해자 관점에서 우호적입니다. P/E {pe} 기준 안전마진은 별도 확인이 필요합니다.",
    ("buffett", "bearish"): "장기 보유 관점의 품질·예측가능성 점수가 낮습니다. {factors}에도 불구하고 안전마진 근거가 부족합니다.",
    ("buffett", "neutral"): "일부 품질 요인은 확인되지만 버핏식 확신에는 부족합니다. {factors}.",
    ("lynch", "bullish"): "매출 성장 {growth}과 성장 스토리가 뚜렷해 GARP 후보입니다. PEG {peg} 기준 가격 대비 성장 매력도도 함께 확인됩니다.",
    ("lynch", "bearish"): "PEG·밸류에이션 확인이 부족하고 린치식 10배주 조건을 충족하지 못했습니다. 성장률 {growth}만으로는 과반 매수 근거가 약합니다.",
    ("lynch", "neutral"): "성장 단서는 있으나 PEG와 밸류에이션 검증이 제한적입니다. {factors}.",
    ("fisher", "bullish"): "성장 품질과 장기 경쟁력 신호가 양호합니다. 매출 성장 {growth}, 모멘텀 {momentum}점이 피셔 관점의 긍정 근거입니다.",
    ("fisher", "bearish"): "장기 성장 품질과 경영·R&D 우위의 증거가 충분하지 않습니다. {factors}.",
    ("fisher", "neutral"): "성장성은 일부 확인되지만 피셔식 장기 확신에는 추가 검증이 필요합니다. {factors}.",
}
NO_FACTORS = "핵심 재무 데이터 제한"


def full_reasoning(investor: Column | str, signal: Column | str, roe: Column | str, pe: Column | str, peg: Column | str, growth: Column | str, momentum: Column | str, factors: Column | str) -> Column:
    """The sentence for an investor and a signal (neutral, if it is another), with N/A for missing figures; other investors get the factors."""
    two = F.when(F.size(_c(factors)) > 0, F.array_join(F.slice(_c(factors), 1, 2), "; ")).otherwise(NO_FACTORS)
    figures = {"roe": percent_text(roe), "pe": number_text(pe), "peg": number_text(peg), "growth": percent_text(growth), "momentum": number_text(momentum), "factors": two}

    def filled(text: str) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*(figures[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))

    out = F.when(F.lit(False), "")
    for name in dict.fromkeys(i for i, _ in REASONS):
        known = F.when(_c(signal) == "bullish", filled(REASONS[name, "bullish"])).when(_c(signal) == "bearish", filled(REASONS[name, "bearish"])).otherwise(filled(REASONS[name, "neutral"]))
        out = out.when(_c(investor) == name, known)
    return out.otherwise(two)


def new_id(key: Column | str, seed: Column | str) -> Column:
    """key and six characters that depend on key and seed only."""
    return F.concat(_c(key), F.lit("_"), F.substring(F.sha2(F.concat_ws(":", _c(key), _c(seed).cast("string")), 256), 1, 6))
