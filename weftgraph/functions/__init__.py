"""Column functions, gathered from the operators that define them."""

from weftgraph.operators.geometry import cosines, in_circle, is_bad, is_obtuse, orientation
from weftgraph.operators.logic import apply_function
from weftgraph.operators.reduce import morton
from weftgraph.operators.report import number_range
from weftgraph.sources.generators import hilbert, uniform

__all__ = ["apply_function", "cosines", "hilbert", "in_circle", "is_bad", "is_obtuse", "morton", "number_range", "orientation", "uniform"]
