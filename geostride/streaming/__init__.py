"""The stateful operators over Structured Streaming: one processor that runs any step function for each device, and the
steps of fixes, trust, survey and log. The same steps, folded over a batch, are the reference for parity tests."""
