"""Where catalog rows come from and go to."""
