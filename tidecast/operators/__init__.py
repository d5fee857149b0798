from tidecast.operators.base import Chain, Operator
from tidecast.operators.calendar import CreateFutureSet, DateFeatures, Densify
from tidecast.operators.columns import (
    Checkpointer,
    ColumnSelect,
    ColumnType,
    ConvertToDate,
    DateCutoff,
    JoinDataFrame,
    MemberFilter,
    members,
)
from tidecast.operators.proximity import TriangleEventEncoder
from tidecast.operators.reshape import MeltDataFrame, PivotForecasts
from tidecast.operators.rolling import TargetEncoder
from tidecast.operators.splits import Fold, TimeBasedSplit

__all__ = [
    "Chain",
    "Checkpointer",
    "ColumnSelect",
    "ColumnType",
    "ConvertToDate",
    "CreateFutureSet",
    "DateCutoff",
    "DateFeatures",
    "Densify",
    "Fold",
    "JoinDataFrame",
    "MeltDataFrame",
    "MemberFilter",
    "Operator",
    "PivotForecasts",
    "TargetEncoder",
    "TimeBasedSplit",
    "TriangleEventEncoder",
    "members",
]
