"""Default texts of this library: parameters wherever they are used, free to be replaced."""

SYSTEM_TEXT = "Answer the question. Say how you got there, and say so when you are not sure."
HARD_CASES_SYSTEM_TEXT = "The next question is known to be easily answered wrongly. Check each step before you give the result."
