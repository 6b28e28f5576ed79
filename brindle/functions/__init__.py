from brindle.functions.numbers import charged, discounted, exact_sum, hundredths, money
from brindle.functions.vectors import dot

__all__ = ["charged", "discounted", "dot", "exact_sum", "hundredths", "money"]
