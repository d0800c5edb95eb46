"""Where flat records come from and go to."""
