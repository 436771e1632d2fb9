from . import candles, safe

__all__ = ["candles", "safe"]
