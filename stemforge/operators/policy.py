"""Control policies as expressions over tables of errors and events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of an error in its message, lower case.
INVALID_KEY = ["api_key_invalid", "api key invalid", "invalid api key", "api-key invalid", "api key not valid", "api-key not valid", "key not valid", "reported as leaked", "known leaked"]
TOO_LARGE = ["context length", "context_length", "context too long", "context too large", "token limit", "max tokens", "maximum tokens", "request too large", "payload too large"]
RATE_LIMIT = ["429", "quota", "exhausted", "resource_exhausted", "too many requests", "rate limit", "ratelimit", "userratelimitexceeded"]
NO_ACCESS = ["permission denied", "forbidden"]
BUSY = ["503", "504", "unavailable", "overloaded", "deadline", "timeout", "econnreset", "failed to fetch", "network error", "network_error", "networkerror", "net::"]
EMPTY = ["không tìm thấy câu hỏi", "khong tim thay cau hoi", "questions.length", "empty"]
MALFORMED = ["ai_format_error", "json", "định dạng", "dinh dang", "format", "unexpected token", "truncated", "bị cắt", "cắt ngang", "chưa xác minh", "thiếu "]
NO_CHANNEL = ["shopaikey_deepseek_vision_group_unsupported", "no available channel"]
TRANSIENT = ["per minute", "requests per minute", "tokens per minute", "rpm", "tpm", "rate limit", "ratelimit", "userratelimitexceeded"]
HARD_QUOTA = ["daily", "per day", "per-day", "billing", "insufficient_quota", "insufficient quota", "quota exceeded for quota metric", "exceeded your current quota", "free tier", "credits"]
KINDS = ["format", "empty", "rateLimit", "serverBusy", "auth", "fatal"]


@dataclass(frozen=True)
class RetryProfile:
    name: str
    attempt_buffer: int
    min_attempts: int
    fallback_after: int
    format_fast_fail: int
    backoff_cap_ms: int
    max_elapsed_ms: int
    split_threshold_chars: int
    max_depth: int
    initial_jitter_ms: tuple[int, int]
    busy_fast_fail: int = 2


#: Fixed values.
PROFILES = {
    "normal": RetryProfile("normal", 3, 4, 6, 2, 45_000, 150_000, 4_000, 0, (500, 1_500)),
    "rescue": RetryProfile("rescue", 2, 3, 2, 1, 20_000, 120_000, 3_000, 1, (750, 2_000)),
}


def any_of(message: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(message, F.lit(s)) for s in signs])


def classify_error(message: Column, status: Column, explicit: Column | None = None) -> Column:
    """Kind of an error: explicit kind, bad key, too large, fatal, rate limit, access, busy, empty, malformed, fatal; the first that fits."""
    m, s = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(status, F.lit(0))
    expired = F.contains(m, F.lit("invalid_grant")) | (F.contains(m, F.lit("token")) & any_of(m, ["expired", "hết hạn"]))
    kind = (
        F.when(any_of(m, INVALID_KEY) | expired, "auth")
        .when(any_of(m, TOO_LARGE) | (s == 413), "format")
        .when(any_of(m, NO_CHANNEL), "fatal")
        .when((s == 400) | any_of(m, ["invalid_argument"]), "fatal")
        .when((s == 429) | any_of(m, RATE_LIMIT), "rateLimit")
        .when(s.isin(401, 403) | m.rlike(r"\b(?:401|403)\b") | any_of(m, NO_ACCESS), "auth")
        .when(s.isin(503, 504) | any_of(m, BUSY), "serverBusy")
        .when(any_of(m, EMPTY), "empty")
        .when(any_of(m, MALFORMED), "format")
        .otherwise("fatal")
    )
    return kind if explicit is None else F.when(explicit.isin(*KINDS), explicit).otherwise(kind)


def is_hard_quota(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return ~any_of(m, TRANSIENT) & any_of(m, HARD_QUOTA)


def is_too_large(message: Column, status: Column) -> Column:
    return (F.coalesce(status, F.lit(0)) == 413) | any_of(F.lower(F.coalesce(message, F.lit(""))), TOO_LARGE)


def retry_decision(message: Column, status: Column, attempts: Column, delay_hint: Column, profile: RetryProfile = PROFILES["normal"]) -> tuple[Column, Column]:
    """Cause and action (retry, split, fail) for an error."""
    kind = classify_error(message, status)
    hard = is_hard_quota(message) & (F.coalesce(delay_hint, F.lit(0)) <= 0)
    cause = F.when(kind == "auth", "auth").when(is_too_large(message, status), "requestTooLarge").when(kind == "rateLimit", F.when(hard, "hardQuota").otherwise("softRateLimit")).otherwise(kind)
    split_from = F.when(cause == "serverBusy", profile.busy_fast_fail).when(cause == "format", profile.format_fast_fail).when(cause == "empty", 2)
    action = (
        F.when(cause.isin("auth", "hardQuota", "fatal"), "fail").when(cause == "requestTooLarge", "split").when(cause == "softRateLimit", "retry").when(attempts >= split_from, "split").otherwise("retry")
    )
    return cause, action


def backoff_ms(kind: Column, attempts: Column, cycles: Column, fresh_key: Column, random: Column, profile: RetryProfile = PROFILES["normal"]) -> Column:
    """Delay before the next attempt, with an injected random number from 0 to 1."""
    low, high = profile.initial_jitter_ms
    base = F.when(kind == "serverBusy", 3500.0).when(kind == "rateLimit", 2500.0).otherwise(2000.0)
    factor = F.when(kind.isin("serverBusy", "format"), 2.0).otherwise(1.7)
    exponent = F.greatest(F.lit(0), F.when(F.coalesce(cycles, F.lit(0)) != 0, cycles).otherwise(attempts - 1))
    most = F.least(F.lit(float(profile.backoff_cap_ms)), base * F.pow(factor, exponent))
    return F.when(fresh_key, low + random * (high - low)).otherwise(F.greatest(F.lit(250.0), random * most))


def breaker_threshold(keys: Column) -> Column:
    return F.when(keys <= 3, 3).when(keys <= 6, 4).when(keys <= 12, 5).otherwise(F.least(F.greatest(F.ceil(keys * 0.25), F.lit(5)), F.lit(10))).cast("int")


def concurrency_scale(pressure: Column, keys: Column) -> Column:
    threshold = breaker_threshold(keys)
    return F.when(pressure >= threshold, 0.25).when(pressure >= threshold / 2, 0.5).otherwise(1.0)


def normalize_rpm(value: Column, default: int = 30) -> Column:
    number = F.round(F.coalesce(value.try_cast("double"), F.lit(float(default)))).cast("int")
    return F.least(F.greatest(number, F.lit(1)), F.lit(600))


def delay_rescue(failures: Column, pressure: Column, blocked_keys: Column, partial_or_split: Column) -> Column:
    return (pressure >= 2) | (blocked_keys >= 3) | ((failures >= 3) & (partial_or_split >= 2))


def duplicate_heavy(raw: Column, added: Column, duplicates: Column, skipped: Column) -> Column:
    return (raw > 0) & (added == 0) & ((duplicates + skipped) / raw >= 0.9)
