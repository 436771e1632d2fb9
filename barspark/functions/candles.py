"""SQL of single-candle and two-candle expressions over ``open, high, low, close``."""

from __future__ import annotations

from ..plans import over

BODY_SIZE = "abs(close - open)"
SHADOW_UPPER = "high - greatest(open, close)"
SHADOW_LOWER = "least(open, close) - low"
RANGE = "high - low"
BULLISH = "close > open"
BEARISH = "close < open"


def previous(column: str, shift: int = 1) -> str:
    return over(f"lag(`{column}`, {shift})")


def change(column: str) -> str:
    return f"(`{column}` - {previous(column)})"


def simple_return() -> str:
    return f"try_divide(close, {previous('close')}) - 1"


def gain() -> str:
    """Rise of the close, 0 when it did not rise or there is no earlier bar."""
    return f"case when {change('close')} > 0 then {change('close')} else 0D end"


def loss() -> str:
    """Fall of the close as a positive number, else 0."""
    return f"case when {change('close')} < 0 then -{change('close')} else 0D end"


def true_range() -> str:
    """Largest of the bar range and the distances of high and low to the previous close."""
    before = previous("close")
    return f"greatest(high - low, abs(high - {before}), abs(low - {before}))"


# Directional movement from the columns up_move and down_move; no earlier bar gives 0.
PLUS_DM = "case when up_move > down_move and up_move > 0 then up_move else 0D end"
MINUS_DM = "case when down_move > up_move and down_move > 0 then down_move else 0D end"
