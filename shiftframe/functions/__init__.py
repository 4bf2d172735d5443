"""Column functions by name, for expressions outside the operators."""

from ..operators.conformal import interval
from ..operators.metrics import covered, label, pinball, ratio, regret, skill, winkler
from ..operators.shifts import keyed_uniform
from ..operators.timeaxis import calendar

__all__ = ["calendar", "covered", "interval", "keyed_uniform", "label", "pinball", "ratio", "regret", "skill", "winkler"]
