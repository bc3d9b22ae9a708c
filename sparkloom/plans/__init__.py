"""Plans: the strict model, front-ends that lower to it, compiler passes, and the runtime."""
