"""Two words that every polynomial hash modulo a power of two confuses: a Thue-Morse string and its complement."""


def thue_morse(n: int = 11) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))


def complement(n: int = 11) -> str:
    return "".join("ba"[bin(i).count("1") % 2] for i in range(1 << n))
