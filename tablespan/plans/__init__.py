"""Driver-side plan choices: staging, sampled filter order, reuse of earlier results."""
