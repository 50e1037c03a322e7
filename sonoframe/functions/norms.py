"""Reference values of vowels."""

from __future__ import annotations

#: Vowel, F1 mean and std, F2 mean and std, F3 mean and std (English); order breaks ties.
ENGLISH = (
    ("AA", 700.96, 141.64, 1147.66, 175.22, 2384.58, 421.38),
    ("AE", 710.97, 171.04, 1644.76, 318.89, 2457.52, 349.54),
    ("AH", 566.63, 127.67, 1306.15, 214.08, 2388.04, 426.7),
    ("AO", 612.01, 156.48, 1087.37, 243.49, 2522.48, 450.76),
    ("EH", 594.66, 120.52, 1631.24, 278.88, 2403.29, 337.6),
    ("ER", 527.49, 117.17, 1519.06, 279.51, 2235.31, 394.33),
    ("EY", 482.06, 106.68, 2026.13, 394.81, 2665.45, 289.51),
    ("IH", 467.33, 98.66, 1902.75, 356.39, 2567.68, 307.08),
    ("IY", 375.23, 133.91, 2111.86, 474.37, 2708.16, 315.75),
    ("OW", 519.63, 100.06, 1254.83, 341.12, 2501.26, 403.66),
    ("UW", 399.73, 137.2, 1575.42, 400.67, 2536.81, 365.52),
    ("AY", 799.82, 145.71, 1446.65, 221.43, 2405.79, 384.57),
    ("OY", 539.5, 97.84, 1216.14, 290.47, 2464.83, 347.06),
)

#: The same for Spanish.
SPANISH = (
    ("A", 750.0, 120.0, 1250.0, 150.0, 2550.0, 300.0),
    ("E", 450.0, 80.0, 1900.0, 200.0, 2600.0, 280.0),
    ("I", 300.0, 70.0, 2300.0, 250.0, 2900.0, 300.0),
    ("O", 500.0, 90.0, 900.0, 150.0, 2550.0, 300.0),
    ("U", 350.0, 80.0, 850.0, 150.0, 2400.0, 300.0),
)

#: Mean and std of the first formant of women's vowels, and the vowels that they stand for.
FEMALE_F1 = (
    ("IH", "ih", 483.0, 56.0),
    ("AH", "uh", 753.0, 83.0),
    ("UW", "oo", 459.0, 78.0),
    ("AA", "ah", 936.0, 104.0),
    ("IY", "ee", 437.0, 62.0),
    ("EH", "eh", 731.0, 82.0),
    ("AO", "aw", 781.0, 98.0),
)

#: Vowels that count as single sounds.
MONOPHTHONGS = ("AA", "AE", "AH", "AO", "EH", "ER", "IH", "IY", "OW", "UH")


def sql(name: str, norms: tuple) -> str:
    """A named SQL table of the norms."""
    rows = ", ".join(f"({i}, '{v}', {', '.join(f'CAST({x} AS DOUBLE)' for x in rest)})" for i, (v, *rest) in enumerate(norms))
    return f"{name}(ord, vowel, m1, s1, m2, s2, m3, s3) AS (VALUES {rows})"


FEMALE_SQL = "female(vowel, label, mean, std) AS (VALUES " + ", ".join(f"('{v}', '{n}', CAST({m} AS DOUBLE), CAST({s} AS DOUBLE))" for v, n, m, s in FEMALE_F1) + ")"
