"""DataFrame building blocks shared by marts, reports and checks."""
