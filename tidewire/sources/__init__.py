"""Where rows come from and go to: domain tables, radio frames, exports and merges."""
