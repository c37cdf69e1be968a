"""Column functions: hashed randomness, quadrants, labels and normal tails."""

from spatlas.functions.columns import cluster_label, hashed_int, inferential_mask, quadrant, quadrant_label, significant, two_sided_p

__all__ = ["cluster_label", "hashed_int", "inferential_mask", "quadrant", "quadrant_label", "significant", "two_sided_p"]
