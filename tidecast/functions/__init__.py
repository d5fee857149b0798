from tidecast.functions.dateparts import DATE_PARTS, week_of_month
from tidecast.functions.errors import n_scored, rmse
from tidecast.functions.periods import Frequency, add_periods, periods_between, shift

__all__ = [
    "DATE_PARTS",
    "Frequency",
    "add_periods",
    "n_scored",
    "periods_between",
    "rmse",
    "shift",
    "week_of_month",
]
