"""Set-oriented operators: compiler and runtime analyses over tables of many plans, calls and trace events."""
